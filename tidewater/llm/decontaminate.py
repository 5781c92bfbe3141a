"""Documents that hold a benchmark passage, by q-gram lemma filtering and banded alignment.

Texts are compared as their letters and digits in lower case (ASCII and Latin-1 letters are folded; spaces,
punctuation and symbols of ASCII and the block of general punctuation go), as bytes. A passage of n bytes with at most
e edits shares n - q + 1 - e * q of its q-grams with its copy, all within e diagonals. So shared q-grams are counted
in overlapping bands of diagonals for each passage; bands that reach the bound are aligned in a band around them, and
those of at most e edits are matches. The edit budget e is ``edit_ratio`` of n, and less where the lemma needs it.
Passages below ``least`` bytes have no edit budget: a match is the same bytes between borders of words, which are
the ends of a text, bytes that don't count, and both sides of any letter from U+3000 on.

The passages' q-grams go to the executors, at most ``index_bytes`` of normalised text at once; a larger benchmark is
read in as many passes over the documents.

Defined results: null texts are empty; an empty document or benchmark gives no match; a passage without letters
and digits never counts; rows that repeat an id are judged one by one; each row names a document and passage once, with the best
alignment; equal passages each count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import positional

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KEEP = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_TABLE_BITS = 22
Q = 10


class Index(NamedTuple):
    items: list[int]
    bodies: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    grams: np.ndarray  # distinct hashes, sorted
    first: np.ndarray  # of each gram, in the postings
    owner: np.ndarray
    place: np.ndarray
    table: np.ndarray
    short: list[tuple[int, np.ndarray, list[list[int]]]]  # length, sorted hashes, item numbers of each


def normalise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes that count, offsets of the rows in them, and where each stood."""
    keep = _KEEP[data]
    quotes = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if len(data) > 2 else np.zeros(0, np.int64)
    for j in range(3):
        keep[quotes + j] = False
    out = _FOLD[data]
    big = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[big] += 0x20
    at = np.flatnonzero(keep)
    return out[at], np.searchsorted(at, off), at


def _hashes(body: np.ndarray) -> np.ndarray:
    return tx.roll(body.astype(np.uint64) + np.uint64(1), Q) * np.uint64(0xD6E8FEB86659FD93)


def _whole(body: np.ndarray, n: int) -> np.ndarray:
    return tx.roll(body.astype(np.uint64) + np.uint64(1), n)


def build(items: list[tuple[int, str | None]], edit_ratio: float, least: int) -> Index | None:
    kept, brief = [], []
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        body, _, _ = normalise(data, np.array([0, len(data)]))
        if len(body):
            (kept if len(body) >= max(least, Q) else brief).append((item, body))
    if not kept and not brief:
        return None
    sizes = np.array([len(b) for _, b in kept], np.int64)
    edits = np.minimum((sizes * edit_ratio).astype(np.int64), (sizes - Q) // Q)
    hashes = [_hashes(b) for _, b in kept]
    none = np.zeros(0, np.int64)
    owner, place, flat = np.repeat(np.arange(len(kept)), sizes - Q + 1), np.concatenate([none, *(np.arange(len(h)) for h in hashes)]), np.concatenate([none.view(np.uint64), *hashes])
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[grams >> np.uint64(64 - _TABLE_BITS)] = True
    by_size: dict[int, dict[int, list[int]]] = {}
    for number, (_, body) in enumerate(brief, len(kept)):
        by_size.setdefault(len(body), {}).setdefault(int(_whole(body, len(body))[0]), []).append(number)
    short = [(n, np.array(sorted(found), np.uint64), [found[h] for h in sorted(found)]) for n, found in sorted(by_size.items())]
    both = kept + brief
    return Index([i for i, _ in both], [b for _, b in both], edits, sizes - Q + 1 - edits * Q, grams, np.append(first, len(flat)), owner[order], place[order], table, short)


def align(item: np.ndarray, region: np.ndarray, low: int, high: int, limit: int) -> int:
    """Least edits between ``item`` and a part of ``region`` along diagonals low..high (region minus item); limit + 1 beyond."""
    width = high - low + 1
    step = np.arange(width)
    cost = np.where((low + step >= 0) & (low + step <= len(region)), 0, limit + 1)  # before the item's first byte any start is free
    padded = np.concatenate([np.zeros(max(0, -low), np.uint8), region, np.zeros(len(item) + width, np.uint8)])
    base = low + max(0, -low)
    for i, c in enumerate(item):
        place = i + low + step  # of the region's byte that meets item[i]
        inside = (place >= 0) & (place < len(region))
        straight = np.where(inside, cost + (padded[base + i : base + i + width] != c), limit + 1)
        skip = np.append(cost[1:], limit + 1) + 1
        best = np.minimum(straight, skip)
        cost = np.minimum.accumulate(best - step) + step
        if cost.min() > limit:
            return limit + 1
    return int(min(cost.min(), limit + 1))


def matches(ix: Index, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, edits, first byte, end byte) of the best match of each row and item."""
    body, bounds, at = normalise(data, off)
    return sorted(_near(ix, body, bounds, at) + _exact(ix, body, bounds, at))


def _exact(ix: Index, body: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The first exact match of each row and short item."""
    if not ix.short or not len(body):
        return []
    lead = np.maximum.accumulate(np.where((body & 0xC0) != 0x80, np.arange(len(body)), 0))
    wide = body[lead] >= 0xE3
    border = np.ones(len(body) + 1, bool)  # before each byte
    border[1:-1] = (np.diff(at) > 1) | wide[1:] | wide[:-1]
    border[bounds] = True
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for n, hashes, owners in ix.short:
        h = _whole(body, n)
        which = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hits = np.flatnonzero((hashes[which] == h) & border[: len(h)] & border[n : n + len(h)])
        row = np.searchsorted(bounds, hits, side="right") - 1
        inside = hits + n <= bounds[row + 1]
        hits, row = hits[inside], row[inside]
        for p, i, k in zip(hits.tolist(), row.tolist(), which[hits].tolist(), strict=True):
            for item in owners[k]:
                if (i, item) not in best and np.array_equal(body[p : p + n], ix.bodies[item]):
                    best[i, item] = 0, int(at[p]), int(at[p + n - 1]) + 1
    return [(i, item, *x) for (i, item), x in best.items()]


def _near(ix: Index, body: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The best match of each row and item that has an edit budget."""
    if not len(ix.need):
        return []
    h = _hashes(body)
    hits = np.flatnonzero(ix.table[h >> np.uint64(64 - _TABLE_BITS)])
    if not len(hits):
        return []
    gram = np.searchsorted(ix.grams, h[hits])
    real = (gram < len(ix.grams)) & (ix.grams[np.minimum(gram, len(ix.grams) - 1)] == h[hits])
    hits, gram = hits[real], gram[real]
    row = np.searchsorted(bounds, hits, side="right") - 1
    real = hits + Q <= bounds[row + 1]
    hits, gram, row = hits[real], gram[real], row[real]
    least = int(ix.need.min())
    if least > 1 and len(hits):
        reach = max(len(b) for b in ix.bodies[: len(ix.need)]) + 2 * int(ix.edits.max())
        dense = np.searchsorted(hits, hits + reach, side="right") - np.searchsorted(hits, hits - reach)
        hits, gram, row = hits[dense >= least], gram[dense >= least], row[dense >= least]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for shift in (0, 1):
        for i, item, near, far, first, last in _bands(ix, hits, gram, row, shift):
            e = int(ix.edits[item])
            lo = max(int(bounds[i]), near - e)
            hi = min(int(bounds[i + 1]), far + len(ix.bodies[item]) + e)
            found = align(ix.bodies[item], body[lo:hi], near - e - lo, far + e - lo, e)
            if found <= e and ((i, item) not in best or found < best[i, item][0]):
                best[i, item] = found, int(at[first]), int(at[last + Q - 1]) + 1
    return [(i, item, *x) for (i, item), x in best.items()]


def _bands(ix: Index, hits: np.ndarray, gram: np.ndarray, row: np.ndarray, shift: int, limit: int = 1 << 20) -> Iterator[tuple[int, ...]]:
    """(row, item, least and largest diagonal, first and last hit) of the bands of diagonals that reach an item's bound.

    Pairs of a hit and a posting are counted ``limit`` at a time, so q-grams that most passages hold take time, not memory.
    """
    many = ix.first[gram + 1] - ix.first[gram]
    ends = np.cumsum(many)
    held: np.ndarray | None = None
    lo = 0
    while lo < len(hits):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        n = many[lo:hi]
        post = np.repeat(ix.first[gram[lo:hi]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit, owner = np.repeat(hits[lo:hi], n), ix.owner[post]
        diagonal = hit - ix.place[post]
        width = 2 * (ix.edits[owner] + 1)
        some = np.stack([np.repeat(row[lo:hi], n), owner, (diagonal + shift * width // 2) // width, np.ones(len(hit), np.int64), diagonal, diagonal, hit, hit])
        held = _merged(some if held is None else np.concatenate([held, _merged(some)], axis=1))
        lo = hi
    if held is not None:
        enough = held[3] >= ix.need[held[1]]
        yield from zip(*(held[j][enough].tolist() for j in (0, 1, 4, 5, 6, 7)), strict=True)


def _merged(x: np.ndarray) -> np.ndarray:
    """Rows, items and bands once, with the sum of counts, the least and largest diagonals, and the first and last hits."""
    x = x[:, np.lexsort((x[2], x[1], x[0]))]
    new = np.ones(x.shape[1], bool)
    new[1:] = (x[:3, 1:] != x[:3, :-1]).any(axis=0)
    start = np.flatnonzero(new)
    if not len(start):
        return x
    ways = np.add, np.minimum, np.maximum, np.minimum, np.maximum
    return np.concatenate([x[:3, start], [way.reduceat(x[3 + j], start) for j, way in enumerate(ways)]])


def _slices(benchmark: DataFrame, item_col: str, text_col: str, index_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's distinct rows in slices of about ``index_bytes``; a passage beyond that is never split."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // index_bytes) or 1
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_ratio: float = 0.08, least: int = 40, index_bytes: int = 16_000_000) -> DataFrame:
    """One row for each document and passage it holds: doc_id, item_id, edits, start, stop (code points of the shared part)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, edits int, start int, stop int"
    out = None
    for items in _slices(benchmark, item_col, item_text_col, index_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(build(items, edit_ratio, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tx.claim("decontaminate")
            ix = shared.value
            for b in batches:
                rows = []
                for lo, _, data, off in tx.chunks(*tx.utf8(b.column(1))) if ix else ():
                    for i, item, edits, first, last in matches(ix, data, off):
                        points = np.cumsum((data[off[i] : off[i + 1]] & 0xC0) != 0x80)
                        rows.append((b.column(0)[lo + i].as_py(), ix.items[item], edits, int(points[first - off[i]]) - 1, int(points[last - 1 - off[i]])))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 3, strict=True)], ["doc_id", "item_id", "edits", "start", "stop"])

        part = base.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_ratio: float = 0.08, least: int = 40, index_bytes: int = 16_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no passage, all columns unchanged; one pass for each slice, no shuffle."""
    at, names = docs.columns.index(text_col), docs.columns
    docs = positional(docs)
    for items in _slices(benchmark, item_col, item_text_col, index_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(build(items, edit_ratio, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tx.claim("decontaminate")
            ix = shared.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, data, off in tx.chunks(*tx.utf8(b.column(at)), limit=1 << 20) if ix else ():
                    keep[[lo + m[0] for m in matches(ix, data, off)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)
