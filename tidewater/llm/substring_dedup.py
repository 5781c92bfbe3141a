"""Removal of word windows that also start in a document with a smaller id, by super-k-mer partitioning.

Every window of ``k`` words has a minimiser, the least hash among its runs of ``m`` words. Consecutive windows with
one minimiser travel as one packed string (a super-k-mer) to the bucket of that minimiser, so equal windows always
meet; there sorting the windows' own words decides equality exactly.

Before strings travel, the minimisers alone do: only those of two documents or more can hold a repeated window. They
reach the scan as a bitmap of fixed size, whose false positives cost traffic and never change a result. When the
corpus outgrows the bitmap, all super-k-mers travel, about three times the text.

A super-k-mer is cut after ``LONGEST`` windows, so that a periodic text is many. A bucket of more than ``hot_windows``
windows is not sorted in one task: its equal strings are first combined to one with the least id, by partial and final
aggregates. Buckets that are small then are sorted as all others; in those still large each window becomes a row, and
the least id for each comes from aggregates too. What is found for a string goes back to its rows by a join, in which a
string of very many rows is an ordinary skewed key.

Defined results: null text has no words; a text below ``k`` words loses nothing; rows with a null id neither lose
words nor make others lose any; rows that repeat an id are judged one by one and never against each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import bitmap, in_bitmap, materialize

LONGEST = 256
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def super_kmers(w: tx.Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and key of each maximal run of windows with one minimiser."""
    n = len(w.start)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = tx.sliding_min(tx.roll(tx.word_hashes(w), m), k - m + 1)
    row = w.row()
    valid = row[: n - k + 1] == row[k - 1 :]
    same = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
    first, last = valid.copy(), valid.copy()
    first[1:] &= ~same
    last[:-1] &= ~same
    start = np.flatnonzero(first)
    return cut(start, np.flatnonzero(last) + 1 - start, tx.mix(least[start]))


def cut(start: np.ndarray, count: np.ndarray, key: np.ndarray, limit: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at most ``limit`` windows."""
    pieces = -(-count // limit)
    if not len(start) or pieces.max() == 1:
        return start, count, key
    run = np.repeat(np.arange(len(start)), pieces)
    at = (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * limit
    return start[run] + at, np.minimum(limit, count[run] - at), key[run]


def _packed(w: tx.Words, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """The words start..stop-1 joined by single spaces, for each pair."""
    keep = ~tx.SPACE[w.data]
    keep[w.end[w.end < len(w.data)]] = True
    flat = w.data[keep]
    flat[tx.SPACE[flat]] = 0x20
    at = np.cumsum(keep)[w.start] - 1
    end = at + (w.end - w.start)
    flat = flat.tobytes()
    return [flat[a:b] for a, b in zip(at[start].tolist(), end[stop - 1].tolist(), strict=True)]


def _minimisers(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, off in tx.chunks(*tx.utf8(b.column(1))):
                w = tx.words(data, off)
                start, count, key = super_kmers(w, k, m)
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(key)), pa.array(ids[lo + w.row()[start]].astype(np.int64)), pa.array(count.astype(np.int64))], ["mh", "doc_id", "windows"])

    return run


def _emit(k: int, m: int, shared, hot, want_hot: bool):
    """Super-k-mers of perhaps-shared minimisers; of hot ones instead, if ``want_hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, prints = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for lo, _, data, off in tx.chunks(*tx.utf8(b.column(2))):
                w = tx.words(data, off)
                start, count, key = super_kmers(w, k, m)
                take = in_bitmap(shared.value, key)
                if hot is not None:
                    take &= in_bitmap(hot.value, key) == want_hot
                start, count, key = start[take], count[take], key[take]
                if not len(start):
                    continue
                row = w.row()[start]
                packed = _packed(w, start, start + count + k - 1)
                cols = [tx.signed(key), ids[lo + row].astype(np.int64), prints[lo + row].astype(np.int64), (start - w.bounds[row]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(packed, pa.binary())], ["mh", "doc_id", "print", "start", "packed"])

    return run


def windows(packed: bytes, k: int) -> list[bytes]:
    ends = [i for i, c in enumerate(packed) if c == 0x20] if len(packed) < 64 else np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20).tolist()
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(packed))
    return [packed[a:b] for a, b in zip(starts, ends[k - 1 :], strict=False)]


def first_owners(owner: dict[bytes, int], k: int) -> dict[bytes, list[int]]:
    """For each string the least owner of each of its windows, by sorting all windows."""
    texts = list(owner)
    own = [windows(t, k) for t in texts]
    firsts = [[0] * len(x) for x in own]
    ordered = sorted((x, owner[t], i, j) for i, (t, ws) in enumerate(zip(texts, own, strict=True)) for j, x in enumerate(ws))
    for _, same in groupby(ordered, key=lambda x: x[0]):
        group = list(same)
        for _, _, i, j in group:
            firsts[i][j] = group[0][1]
    return dict(zip(texts, firsts, strict=True))


def spans(doc: int, firsts: list[int], start: int, k: int) -> Iterator[tuple[int, int]]:
    """Runs of words under a window whose least owner is smaller than ``doc``."""
    at, to = -1, -1
    for j, first in enumerate(firsts):
        if first < doc:
            if j > to:
                if to >= 0:
                    yield start + at, start + to
                at = j
            to = j + k
    if to >= 0:
        yield start + at, start + to


def covered(bucket: list[tuple[int, int, int, bytes]], k: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of words under a window that a smaller id has too: (doc_id, print, from, to), for one bucket's rows in order of id."""
    owner: dict[bytes, int] = {}
    for doc, _, _, packed in bucket:
        owner.setdefault(packed, doc)
    if len(owner) == 1:
        least = bucket[0][0]
        for doc, mark, start, packed in bucket:
            if doc > least:
                yield doc, mark, start, start + packed.count(b" ") + 1
        return
    of = first_owners(owner, k)
    for doc, mark, start, packed in bucket:
        for a, b in spans(doc, of[packed], start, k):
            yield doc, mark, a, b


def _reduce(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        key = None
        out: list[tuple[int, int, int, int]] = []

        def done() -> None:
            if len(held) > 1 and held[0][0] != held[-1][0]:
                out.extend(covered(held, k))
            held.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "print", "start", "stop"])

        for b in batches:
            keys = b.column(0).to_pylist()
            for mh, row in zip(keys, zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True), strict=True):
                if mh != key:
                    done()
                    key = mh
                held.append(row)
            if len(out) > 50_000:
                yield flush()
        done()
        yield flush()

    return run


def _reduce_strings(k: int):
    """(mh, packed, firsts) of the distinct strings (mh, packed, owner) of each bucket, which are side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        key = None

        def done() -> pa.RecordBatch:
            found = first_owners(held, k)
            out = pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["mh", "packed", "firsts"])
            held.clear()
            return out

        for b in batches:
            for mh, packed, owner in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if mh != key:
                    if held:
                        yield done()
                    key = mh
                held[packed] = owner
        if held:
            yield done()

    return run


def _explode(k: int):
    """(mh, packed, at, window, owner) of every window of distinct strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for mh, packed, owner in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ws = windows(packed, k)
                n = len(ws)
                yield pa.RecordBatch.from_arrays([pa.array([mh] * n), pa.array([packed] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(ws, pa.binary()), pa.array([owner] * n)], ["mh", "packed", "at", "window", "owner"])

    return run


def _spans_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, mark, a, z) for doc, mark, start, firsts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for a, z in spans(doc, firsts, start, k)]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "print", "start", "stop"])

    return run


def _hot_spans(rows: DataFrame, k: int, hot_windows: int) -> DataFrame:
    """Spans of the rows of large buckets."""
    span = "doc_id long, print long, start long, stop long"
    count = F.size(F.split(F.col("packed").cast("string"), " ")) - (k - 1)
    strings = materialize(rows.groupBy("mh", "packed").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).withColumn("windows", count), "strings")
    sizes = strings.groupBy("mh").agg(F.sum("windows").alias("all"), F.count("*").alias("strings"))
    sized = strings.join(sizes, "mh")
    small = sized.where(F.col("all") <= hot_windows).select("mh", "packed", "owner").repartition("mh").sortWithinPartitions("mh")
    firsts = small.mapInArrow(_reduce_strings(k), "mh long, packed binary, firsts array<long>")
    large = sized.where(F.col("all") > hot_windows).select("mh", "packed", "owner")
    if not large.isEmpty():
        each = materialize(large.mapInArrow(_explode(k), "mh long, packed binary, at int, window binary, owner long"), "windows")
        first = materialize(each.groupBy("window").agg(F.min("owner").alias("first")), "firsts")  # so that a skewed window can be split
        lists = each.join(first, "window").groupBy("mh", "packed").agg(F.array_sort(F.collect_list(F.struct("at", "first"))).alias("x"))
        firsts = firsts.unionByName(lists.select("mh", "packed", F.transform("x", lambda x: x["first"]).alias("firsts")))
    return rows.join(firsts, ["mh", "packed"]).select("doc_id", "print", "start", "firsts").mapInArrow(_spans_of(k), span)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, spans = b.column(0), b.column(2)
        for lo, hi, data, off in tx.chunks(*tx.utf8(b.column(1)), limit=1 << 23):
            raw, rows = data.tobytes(), []
            for r in range(lo, hi):
                words = raw[off[r - lo] : off[r - lo + 1]].split()
                n = len(words)
                if spans[r].is_valid:
                    keep = bytearray(b"\1") * n
                    for x in spans[r].as_py():
                        keep[x["start"] : x["stop"]] = bytes(x["stop"] - x["start"])
                    words = list(compress(words, keep))
                kept = b" ".join(words)
                rows.append((n, n - len(words), kept, hashlib.sha256(kept).hexdigest()))
            n, removed, kept, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([x.decode() for x in kept], pa.string()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 50, m: int = 8, filter_bits: int = 26, hot_windows: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, kept_sha256. See the module's text.

    k: words of a window. m: words of a minimiser, 1 to k. filter_bits: the bitmap has 2**filter_bits bits.
    hot_windows: buckets with more windows are never sorted in one task before their equal strings are combined.
    """
    if not 1 <= m <= k:
        raise ValueError("m must be from 1 to k")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = base.where("doc_id is not null")
    seen = known.mapInArrow(_minimisers(k, m), "mh long, doc_id long, windows long")
    shared = materialize(seen.groupBy("mh").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("windows").alias("n")).where("a < b").select("mh", "n"), "minimisers")
    bits = spark.sparkContext.broadcast(bitmap(shared, F.col("mh"), filter_bits))
    large = shared.where(F.col("n") > hot_windows)
    hot = None if large.isEmpty() else spark.sparkContext.broadcast(bitmap(large, F.col("mh"), min(filter_bits, 20)))

    marked = known.select("doc_id", F.xxhash64("text").alias("print"), "text")
    packed = "mh long, doc_id long, print long, start long, packed binary"
    found = marked.mapInArrow(_emit(k, m, bits, hot, False), packed).repartition("mh").sortWithinPartitions("mh", "doc_id").mapInArrow(_reduce(k), "doc_id long, print long, start long, stop long")
    if hot is not None:
        found = found.unionByName(_hot_spans(materialize(marked.mapInArrow(_emit(k, m, bits, hot, True), packed), "hot"), k, hot_windows))
    found = found.groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    keyed = base.select("doc_id", F.xxhash64("text").alias("print"), "text")
    return keyed.join(found.hint("shuffle_hash"), ["doc_id", "print"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, RESULT)
