"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model compiles to three machines:

* the normaliser reads the text by the rules of the model's character map, the longest first, and writes what they say
  (characters without a rule stand for themselves); its state is whether the last character was a space, by which it
  drops extra spaces if the model asks for that; it writes spaces as the meta symbol and adds the dummy prefix;
* the piece machine reads characters along a trie and writes piece ids; its states are the pieces just written. For
  unigram models an arc costs minus the score of its piece. For byte-pair models an arc from piece a to piece b costs 0
  if merging a's and b's characters by the model's scores ends in exactly a, b, and infinity if not;
* the fallback machine reads a character without a piece and writes its UTF-8 bytes, or the unknown id, at a cost above
  any piece's.

The input is composed with them lazily, arc by arc from the positions that a finite path reaches, and the tropical
shortest path is the encoding: byte-pair merging gives the one sequence whose neighbours are all compatible, so its
path is the only finite one. User-defined pieces pass the normaliser as they are; byte-pair models read them before
anything else, the longest first, and in unigram models their arcs cost nothing.

No piece holds the meta symbol after another character (else texts stay whole), nor a character without a piece, nor
two characters side by side that no piece has side by side; so the path splits there, and each distinct segment is
solved once.

Defined results: a null text is empty and has no ids; decoding inverts encoding for every text without U+2581 (a
literal meta symbol reads back as a space) that the normaliser leaves as it is; ids that aren't of the model raise an
error; repeated rows repeat results.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

META = "▁"
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_BPE, _UNIGRAM = 2, 1
_LONG = 64  # characters beyond which a segment isn't remembered, so that memories stay small
_UNIT = 10.0  # cost of a character that falls back to bytes, above any piece's in a unigram model


class CharacterMap:
    """Rules of a compiled character map: a double-array trie over UTF-8 and the strings that its values point to."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and output of the longest rule that reads ``data`` from ``at`` on."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if node >= len(units) or units[node] & 0x800000FF != c:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normaliser:
    """From text to what the piece machine reads."""

    def __init__(self, rules: CharacterMap | None = None, dummy_prefix: bool = True, drop_spaces: bool = False, user: re.Pattern | None = None) -> None:
        self.rules, self.dummy_prefix, self.drop_spaces, self.user = rules, dummy_prefix, drop_spaces, user
        self.known: dict[str, str] = {}

    def _mapped(self, text: str) -> str:
        data, at, out = text.encode(), 0, []
        while at < len(data):
            rule = self.rules.longest(data, at)
            if rule is None:
                first = data[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                rule = n, data[at : at + n]
            out.append(rule[1])
            at += rule[0]
        return b"".join(out).decode()

    def arcs(self, text: str) -> str:
        """The outputs of the rules along ``text``; plain ASCII words, which most rules leave alone, are remembered."""
        if self.rules is None:
            return text
        out = []
        for part in re.split(r"((?<=[a-zA-Z]) (?=[a-zA-Z]))", text):
            got = self.known.get(part)
            if got is None:
                got = self._mapped(part)
                if len(part) <= _LONG:
                    if len(self.known) > 100_000:
                        self.known.clear()
                    self.known[part] = got
            out.append(got)
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.user:
            out, at = [], 0
            for m in self.user.finditer(text):
                out += [self.arcs(text[at : m.start()]), m[0]]
                at = m.end()
            text = "".join([*out, self.arcs(text[at:])])
        else:
            text = self.arcs(text)
        if self.drop_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        return (META if self.dummy_prefix and text else "") + text.replace(" ", META)


class Pieces:
    """The trie of a model's pieces; an arc reads one of them."""

    def __init__(self, ids: dict[str, int]) -> None:
        self.trie: dict = {}
        for p, i in ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i


class Fallback:
    """Reads one character and writes its bytes, or the unknown id."""

    def __init__(self, by_byte: dict[int, int], unknown: int, cost: float) -> None:
        self.by_byte, self.unknown, self.cost = by_byte, unknown, cost

    def output(self, c: str) -> tuple[int, ...]:
        return tuple(self.by_byte[b] for b in c.encode()) if self.by_byte else (self.unknown,)


class Transducer:
    """The machines of one model and their composition with a text."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool = True, dummy_prefix: bool = True, collapse_spaces: bool = False, unknown: int = 0, rules: CharacterMap | None = None) -> None:
        self.pieces, self.bpe, self.dummy_prefix, self.unknown = pieces, bpe, dummy_prefix, unknown
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL or (kind == _USER and not bpe)}
        self.users = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _USER}
        normal = [s for _, s, kind in pieces if kind == _NORMAL]
        self.score = [0.0 if kind == _USER else s for _, s, kind in pieces]
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.length = [len(p) for p, _, _ in pieces]
        self.rank = {p: self.score[i] for p, i in self.ids.items()}
        raw_users = sorted((p.replace(META, " ") for p in self.users), key=len, reverse=True)
        self.normalise = Normaliser(rules, dummy_prefix, collapse_spaces, re.compile("|".join(map(re.escape, raw_users))) if raw_users else None)
        self.user = re.compile("(" + "|".join(re.escape(p.replace(" ", META)) for p in raw_users) + ")") if raw_users and bpe else None
        self.machine = Pieces(self.ids)
        self.fallback = Fallback(self.bytes, unknown, _UNIT - min(normal, default=0.0))
        known = {c for p in self.ids for c in p}
        odd = "".join(map(re.escape, sorted(known - {META})))
        if any(META in p.lstrip(META) for p in self.ids):
            self.segment = re.compile(f"[{odd}{META}]+|[^{odd}{META}]", re.S) if odd else re.compile(".", re.S)
        else:
            self.segment = re.compile(f"{META}+[{odd}]*|[{odd}]+|[^{odd}{META}]") if odd else re.compile(".", re.S)
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.raw = [bytes([int(p[1:-1], 16)]) if kind == _BYTE else p.replace(META, " ").encode() for p, _, kind in pieces]
        self.limit = 1_300_000  # segments whose ids are remembered
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> Transducer:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type not in (_BPE, _UNIGRAM):
            raise ValueError("only byte-pair and unigram models compile to this machine")
        spec = m.normalizer_spec
        if m.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("models that write spaces as suffixes or as they are aren't supported")
        rules = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        unknown = next((i for i, p in enumerate(m.pieces) if p.type == _UNKNOWN), 0)
        return cls([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type == _BPE, spec.add_dummy_prefix, spec.remove_extra_whitespaces, unknown, rules)

    def _merged(self, text: str) -> list[str]:
        """Merging by scores, best pair first and leftmost among equals: decides what is compatible."""
        parts, rank, none = list(text), self.rank.get, -float("inf")
        scores = [rank(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the arc from piece a (-1: the start) to piece b has a finite cost."""
        key = a, b
        fit = self.fits.get(key)
        if fit is None:
            left, right = self.pieces[a][0] if a >= 0 else "", self.pieces[b][0]
            if a < 0:
                fit = self._merged(right) == [right]
            else:
                fit = left + right not in self.ids and self.compatible(-1, b) and self._merged(left + right) == [left, right]
            self.fits[key] = fit
        return fit

    def shortest(self, text: str) -> tuple[int, ...]:
        """Outputs of the tropical shortest path of the composition with a normalised text.

        Positions are taken in order; each keeps the cost and last arc of its best path, which for byte-pair models
        is the only one of finite cost, so the piece it ends in is the machine's state there.
        """
        n, infinite = len(text), float("inf")
        best = [infinite] * (n + 1)
        last = [-1] * (n + 1)  # the piece that ends here; -2: a character by the fallback machine
        best[0] = 0.0
        bpe, fits, compatible, score, ids = self.bpe, self.fits, self.compatible, self.score, self.ids
        for i in range(n):
            cost = best[i]
            if cost == infinite:
                continue
            node, state = self.machine.trie, last[i]
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    k = node[""]
                    if bpe:
                        if best[j + 1] == infinite:
                            fit = fits.get((state, k))
                            if compatible(state, k) if fit is None else fit:
                                best[j + 1], last[j + 1] = cost, k
                    elif cost - score[k] < best[j + 1]:
                        best[j + 1], last[j + 1] = cost - score[k], k
            if text[i] not in ids and cost + self.fallback.cost < best[i + 1]:
                best[i + 1], last[i + 1] = cost + self.fallback.cost, -2
        out: list[int] = []
        at = n
        while at:
            k = last[at]
            out.extend((k,) if k >= 0 else self.fallback.output(text[at - 1])[::-1])
            at -= self.length[k] if k >= 0 else 1
        return tuple(out[::-1])

    def solve(self, segment: str) -> tuple[int, ...]:
        if self.bpe and segment in self.users:
            return (self.users[segment],)
        if len(segment) == 1 and segment not in self.ids:
            return self.fallback.output(segment)
        out: list[int] = []
        at = 0
        for i in range(1, len(segment) + 1):
            if i == len(segment) or segment[i - 1 : i + 1] not in self.beside:
                part = segment[at:i]
                ids = self.parts.get(part)
                if ids is None:
                    ids = self.shortest(part)
                    if len(part) <= _LONG:
                        if len(self.parts) > self.limit:
                            self.parts.clear()
                        self.parts[part] = ids
                out.extend(ids)
                at = i
        return tuple(out)

    def _segments(self, text: str) -> list[str]:
        if self.user is None:
            return self.segment.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.user.split(text)):
            out += [part] if i % 2 else self.segment.findall(part)
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers."""
        segments = self._segments(self.normalise(text))
        try:
            out = b"".join(map(self.cache.__getitem__, segments))
        except KeyError:
            if len(self.cache) > self.limit:
                self.cache.clear()
            if len(self.fits) > 2 * self.limit:
                self.fits.clear()
            long: dict[str, bytes] = {}
            for s in set(segments):
                if s not in self.cache:
                    (self.cache if len(s) <= _LONG else long)[s] = array("I", self.solve(s)).tobytes()
            out = b"".join([self.cache.get(s) or long[s] for s in segments])
        return out if self.bytes else self._joined(out)

    def _joined(self, raw: bytes) -> bytes:
        """Without bytes to fall back to, a run of unknown characters is one id."""
        ids = np.frombuffer(raw, np.uint32)
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
        return ids[keep].tobytes()

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The inverse machine: pieces and bytes back to text, without the dummy prefix."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """The machine of a model file, compiled once in each process."""
    if path not in _machines:
        _machines[path] = Transducer.load(path)
    return _machines[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, cache_segments: int = 1_300_000) -> DataFrame:
    """One row per input row: doc_id, ids (if wanted), n_ids, n_bytes (ids of the fallback), ids_crc32, round_trip."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        tx.claim("sentencepiece", m.cache, m.parts, m.fits)
        m.limit = cache_segments
        fallback = set(m.bytes.values())
        is_byte = np.zeros(len(m.pieces), bool)
        is_byte[list(fallback)] = True
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                raw = [m.encode_bytes(t) for t in texts]
                arrays = [np.frombuffer(x, np.uint32) for x in raw]
                cols = {
                    "doc_id": part.column(0),
                    "ids": pa.array([x.view(np.int32) for x in arrays], pa.list_(pa.int32())) if with_ids else None,
                    "n_ids": pa.array([len(x) for x in arrays], pa.int64()),
                    "n_bytes": pa.array([int(is_byte[x].sum()) for x in arrays], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    "round_trip": pa.array([m.decode(array("I", x)) == t for x, t in zip(raw, texts, strict=True)]),
                }
                cols = {k: v for k, v in cols.items() if v is not None}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, {'ids array<int>, ' if with_ids else ''}n_ids long, n_bytes long, ids_crc32 long, round_trip boolean")


def decode_documents(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text from arrays of ids; a null array is an empty text."""
    base = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text string")
