"""Token ids as flat unsigned integer files with 64-bit document offsets, for memory-mapped reading.

Layout of a dataset folder, one pair of files for each shard, shards in ascending order of document id:

* ``NNNNNN.ids``: the ids of the shard's documents one after another, little-endian uint16 if the vocabulary has at
  most 65,536 ids, else uint32;
* ``NNNNNN.idx``: ``TIDEIDX1``, then little-endian 64-bit: number n of documents, bytes of an id, n + 1 offsets in ids,
  n document ids, n bytes that are 1 where the document id is null.

A range partitioning by id makes the shards; each task writes its shard under a name of its own attempt and renames
it, so a repeated task leaves the same file. The driver gets one small row for each shard, and a prefix sum over their
totals gives each shard's base in the whole sequence.

Defined results: a null text is empty, so its document has the end id alone; rows with a null id come first; rows that
repeat an id stay separate, in order of their texts.
"""

from __future__ import annotations

import os
import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .scratch import new_path

MAGIC = b"TIDEIDX1"
_caches: dict[str, tuple] = {}
_PUNCTUATION = string.punctuation.encode()
_SOLID = np.isin(np.arange(256), list((string.ascii_letters + string.digits).encode())).tolist()
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


class Dataset(NamedTuple):
    folder: str
    tokens: list[int]  # of each shard
    bases: list[int]


def _halves(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Each word's lower-case core and its closing punctuation, if they encode apart, else the word as it is.

    The pre-tokenizer cuts between a letter or digit and punctuation, and the normaliser lowers letters anyway.
    """
    for word in words:
        core = word.rstrip(_PUNCTUATION)
        solid = core and (_SOLID[core[-1]] or core[-2:-1] == b"\xc3" and core[-1] not in (0x97, 0xB7))  # ASCII, or U+00C0 to U+00FF without the signs of times and division
        yield (core.lower(), word[len(core) :]) if solid and b"<" not in core else (word, b"")


def _final(tokenizer) -> frozenset[int]:
    """Ids of the pieces that end a pre-token, where the model marks them."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    return frozenset(i for piece, i in tokenizer.get_vocab(with_added_tokens=False).items() if suffix and piece.endswith(suffix))


def _encoded(tokenizer, final: frozenset[int], pieces: list[bytes], together: int = 1000) -> Iterator[tuple[bytes, bytes]]:
    """Pieces and their ids. Those of lower-case letters alone are one pre-token each, so many are encoded as one text, which the final pieces cut again."""
    texts = [p.decode() for p in pieces]
    plain = [t for t in texts if _PLAIN.fullmatch(t)] if final else []
    groups = [plain[at : at + together] for at in range(0, len(plain), together)]
    alone = [t for t in texts if not _PLAIN.fullmatch(t)] if final else texts
    for group, e in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
        ids = e.ids
        ends = [k for k, i in enumerate(ids, 1) if i in final]
        if len(ends) != len(group) or ends[-1] != len(ids):
            alone += group
            continue
        raw = array("I", ids).tobytes()
        yield from ((t.encode(), raw[4 * a : 4 * z]) for t, a, z in zip(group, [0, *ends], ends, strict=False))
    for t, e in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
        yield t.encode(), array("I", e.ids).tobytes()


def word_encoder(path: str, cache_words: int = 1_000_000) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Encodes texts to uint32 ids, one after another, and the offsets of the texts in them; null counts as empty.

    Each distinct piece between ASCII white space is encoded once: the pre-tokenizer never spans white space and the
    normaliser never looks across it, so a text's ids are those of its pieces one after another (tests hold this
    against whole texts). The memories of known words and of their cores are emptied at ``cache_words``, and at 1.6
    times that.
    """
    if path not in _caches:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        _caches[path] = tokenizer, _final(tokenizer), {}, {}
    tokenizer, final, known, cores = _caches[path]
    tx.claim("binary_output", known, cores)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > cache_words:
            known.clear()
        if len(cores) > 1.6 * cache_words:
            cores.clear()
        known[b""] = cores[b""] = b""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in known]
        if new:
            halves = list(_halves(new))
            cores.update(_encoded(tokenizer, final, list({x for pair in halves for x in pair if x not in cores})))
            known.update(zip(new, (cores[a] + cores[b] for a, b in halves), strict=True))
        raw = list(map(known.__getitem__, distinct))
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        start, pool = np.cumsum(size) - size, np.frombuffer(b"".join(raw), np.uint32)
        which = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[which])])
        out = np.empty(ends[-1], np.uint32)
        for lo in range(0, len(which), 1 << 17):
            some = which[lo : lo + (1 << 17)]
            first, last = ends[lo], ends[lo + len(some)]
            out[first:last] = pool[np.arange(first, last) + np.repeat(start[some] - ends[lo : lo + len(some)], size[some])]
        return out, ends[bounds - bounds[0]]

    return encode


def vocabulary_of(path: str) -> int:
    """One more than the largest id of a tokenizer."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0) + 1


def local_folder(path: str) -> str:
    """Memory mapping needs a folder that every machine mounts."""
    if "://" in path and not path.startswith("file://") or path.startswith(("hdfs:", "s3a:", "viewfs:")):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {path}")
    return path.removeprefix("file://").removeprefix("file:")


def write_shard(folder: str, k: int, width: int, docs: Iterator[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Writes uint32 ids of documents as shard k; its documents and ids."""
    mark, offsets, ids = uuid.uuid4().hex, [0], []
    stem = f"{folder}/{k:06d}"
    with open(f"{stem}.{mark}", "wb") as f:
        for doc, raw in docs:
            wide = np.frombuffer(raw, np.uint32)
            if width == 2 and len(wide) and wide.max() >= 1 << 16:
                raise ValueError("an id doesn't fit the width of the files")
            f.write(raw if width == 4 else wide.astype(np.uint16).tobytes())
            ids.append(doc)
            offsets.append(offsets[-1] + len(raw) // 4)
    with open(f"{stem}.{mark}x", "wb") as f:
        f.write(MAGIC + struct.pack("<QQ", len(ids), width))
        f.write(np.array(offsets, "<u8").tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes() + bytes(x is None for x in ids))
    os.replace(f"{stem}.{mark}", f"{stem}.ids")
    os.replace(f"{stem}.{mark}x", f"{stem}.idx")
    return len(ids), offsets[-1]


def read_shard(folder: str, k: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Document id, offset in the shard and a view of the mapped ids, document by document."""
    with open(f"{folder}/{k:06d}.idx", "rb") as f:
        head = f.read()
    if head[:8] != MAGIC:
        raise ValueError("not an index of this format")
    n, width = struct.unpack_from("<QQ", head, 8)
    offsets = np.frombuffer(head, "<u8", n + 1, 24).tolist()
    docs = np.frombuffer(head, "<i8", n, 24 + 8 * (n + 1)).tolist()
    null = head[24 + 8 * (2 * n + 1) :]
    name = f"{folder}/{k:06d}.ids"
    ids = np.memmap(name, f"<u{width}", "r") if os.path.getsize(name) else np.zeros(0, f"<u{width}")
    for i in range(n):
        yield None if null[i] else docs[i], offsets[i], ids[offsets[i] : offsets[i + 1]]


def write_dataset(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, vocabulary: int | None = None) -> Dataset:
    """Encodes every document and writes the shards; ``folder`` must be shared, and defaults to one in the scratch space.

    vocabulary: a number above all ids, by default the tokenizer's own, which decides the bytes of an id.
    """
    spark = docs.sparkSession
    folder = local_folder(folder or new_path(spark, "tokens"))
    os.makedirs(folder, exist_ok=True)
    end = b"" if end_id is None else np.array([end_id], np.uint32).tobytes()
    width = 2 if max(vocabulary or vocabulary_of(tokenizer), (end_id or 0) + 1) <= 1 << 16 else 4
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for b in batches:
                ids = b.column(0).to_pylist()
                for lo, hi, _, _ in tx.chunks(*tx.utf8(b.column(1)), limit=1 << 22):
                    flat, bounds = encode(b.column(1).slice(lo, hi - lo))
                    raw, cut = flat.tobytes(), (4 * bounds).tolist()
                    for doc, x, y in zip(ids[lo:hi], cut, cut[1:], strict=False):
                        yield doc, raw[x:y] + end

        k = TaskContext.get().partitionId()
        n, tokens = write_shard(folder, k, width, encoded())
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n]), pa.array([tokens])], ["shard", "docs", "tokens"])

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    rows = sorted(ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, "shard long, docs long, tokens long").collect())
    tokens = [r["tokens"] for r in rows]
    return Dataset(folder, tokens, [0, *accumulate(tokens)][:-1])


def read_dataset(spark: SparkSession, data: Dataset) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (over uint32), read back from the files."""
    folder, bases = data.folder, data.bases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                rows = [(doc, bases[k] + at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))) for doc, at, ids in read_shard(folder, k)]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = len(data.tokens)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
