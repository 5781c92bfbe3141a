"""Near-duplicate classes by BagMinHash signatures, banding, and verified multiset overlap.

A document is the multiset of its runs of five words (all its words, if fewer). Its weight of a shingle is the count.
Each shingle owns Poisson processes over the weight axis, one for each dyadic interval [0, 1), [1, 2), [2, 4), ...;
a point carries a time, a weight and a register, all from hashes, and counts in a document if its weight lies below
the document's. The first point of each register is the signature, so two registers agree with a probability that
equals the weighted Jaccard similarity, and a count c costs log c processes in place of c. Times beyond the point
where all registers are filled are never generated.

Bands of registers deal the distinct texts into buckets. In each bucket the most central text, whose buckets hold the
most members, is compared with the others; a central text with many partners is copied to parts of ``fan`` of them.
Two members of different classes are then never both of the class of the central one, so only the odd members, those
of another class, are laid against all others of the bucket, in blocks of 64 by 64, each pair in the first bucket that
its band keys share. Two bounds that never err spare most of these comparisons: sizes, and parity bitmaps, whose
distance is at most the symmetric difference of the multisets. A block yields one link for each two classes. So no
pair of a bucket stays unlinked, yet a bucket of n copies of one text costs n comparisons. A comparison is exact: the
weighted Jaccard similarity of the two multisets of 64-bit shingle hashes.

Defined results: null texts and texts without words are linked to nothing; equal sequences of words are one text;
rows with a null id form no class (null class_id); rows that repeat an id and text share its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .scratch import bitmap, drop, in_bitmap, materialize

_LEVEL = np.uint64(0x8CB92BA72F3D8DD7)
_POINT = np.uint64(0x9E3779B97F4A7C15)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bags(w: tx.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles, in order of the row."""
    h, n_words = tx.word_hashes(w), np.diff(w.bounds)
    row = w.row()
    rolled = tx.roll(h, size)
    whole = row[: len(rolled)] == row[size - 1 :] if len(rolled) else np.zeros(0, bool)
    r, s = row[: len(rolled)][whole], rolled[whole]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        alone = np.array([tx.roll(h[w.bounds[i] : w.bounds[i + 1]], int(n_words[i]), 0x94D049BB133111EB)[0] for i in short], np.uint64)
        r, s = np.concatenate([r, short]), np.concatenate([s, alone])
    s = tx.mix(s)
    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return r[at], s[at], np.diff(np.append(at, len(s)))


def signatures(row: np.ndarray, item: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """BagMinHash: rows x m uint64, the identity of the first point of each register (all zero for an empty bag)."""
    total = np.bincount(row, weight, rows)
    best = np.full(rows * m, np.inf)
    todo = total > 0
    horizon = m * (np.log(m) + 5.0) / np.maximum(total, 1)
    while todo.any():
        best.reshape(rows, m)[todo] = np.inf
        level, top = 0, int(weight.max())
        while level == 0 or 1 << (level - 1) < top:
            low = 0 if level == 0 else 1 << (level - 1)
            rate = float(max(1, low))
            own = np.flatnonzero((weight > low) & todo[row])
            r, t = row[own], np.zeros(len(own))
            state = tx.mix(item[own] ^ tx.mix(np.array([level + 1], np.uint64)))
            limit, w = horizon[r], weight[own]
            while len(r):
                state = state + _POINT
                h = tx.mix(state)
                t = t - np.log(_unit(h)) / rate
                live = t < limit
                r, t, state, limit, w = r[live], t[live], state[live], limit[live], w[live]
                h = tx.mix(h[live] ^ _LEVEL)
                good = slice(None) if level == 0 else low + _unit(tx.mix(h)) * rate < w
                np.minimum.at(best, r[good] * m + (h[good] % np.uint64(m)).astype(np.int64), t[good])
            level += 1
        horizon *= 2
        todo &= np.isinf(best.reshape(rows, m)).any(axis=1)
    return np.where(np.isinf(best), 0, best).view(np.uint64).reshape(rows, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    depth = sig.shape[1] // bands
    key = np.zeros((len(sig), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _LEVEL
    for j in range(depth):
        key = tx.mix(key ^ sig[:, j : bands * depth : depth])
    return key


def prints(w: tx.Words) -> np.ndarray:
    """A 64-bit fingerprint of each row's sequence of words; 0 for none."""
    n = np.diff(w.bounds)
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        at = np.arange(len(w.start)) - np.repeat(w.bounds[:-1], n)
        out[full] = np.add.reduceat(tx.word_hashes(w) * tx.powers(int(n.max()) + 1)[0][at], w.bounds[:-1][full])
        out[full] = tx.mix(out[full] + n[full].astype(np.uint64)) | np.uint64(1)
    return out


def _sign(size: int, m: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.claim("near_dedup")
        for b in batches:
            for lo, hi, data, off in tx.chunks(*tx.utf8(b.column(1)), limit=1 << 20):
                w = tx.words(data, off)
                sig = signatures(*bags(w, size), hi - lo, m)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * bands, bands, dtype=np.int32)), pa.array(tx.signed(band_keys(sig, bands).ravel())))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(tx.signed(prints(w))), lists], ["doc_id", "print", "node", "bands"])

    return run


def parities(flat: np.ndarray, sizes: np.ndarray, bits: int = 2048) -> np.ndarray:
    """Rows of 0 and 1: for each bag, whether an odd number of its hashes falls into each cell."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = owner * bits + (flat & np.int64(bits - 1))
    return (np.bincount(cell, minlength=len(sizes) * bits) & 1).astype(np.float32).reshape(len(sizes), bits)


class _Side:
    """A block of members of one bucket."""

    def __init__(self, v: pa.StructArray, bands: int) -> None:
        bag = v.field("bag")
        self.sizes = bag.value_lengths().to_numpy().astype(np.int64)
        flat = bag.flatten().to_numpy()
        self.node, self.label, self.keys = v.field("node").to_numpy(), v.field("label").to_numpy(), v.field("bands").flatten().to_numpy().reshape(-1, bands)
        self.parity = parities(flat, self.sizes)
        self.bags = np.split(flat, np.cumsum(self.sizes)[:-1])


def _block_links(bands: int, threshold: float):
    """Links of two blocks of one bucket between different classes, at the first band whose keys a pair shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for band, left, right in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                x, y = _Side(left.values, bands), _Side(right.values, bands)
                both = x.sizes[:, None] + y.sizes
                apart = x.parity.sum(axis=1)[:, None] + y.parity.sum(axis=1) - 2 * (x.parity @ y.parity.T)
                todo = (x.label[:, None] != y.label) & (np.minimum(x.sizes[:, None], y.sizes) >= threshold * np.maximum(x.sizes[:, None], y.sizes))
                todo &= both - apart + 0.5 >= threshold * (both + apart)
                out, met = [], set()
                if todo.any():
                    todo &= (x.keys[:, None, :] == y.keys).argmax(axis=2) == band
                for i, j in zip(*(c.tolist() for c in np.nonzero(todo)), strict=True):
                    if (x.label[i], y.label[j]) in met:
                        continue
                    shared = len(np.intersect1d(x.bags[i], y.bags[j], assume_unique=True))
                    if shared >= threshold * (both[i, j] - shared):
                        met.add((x.label[i], y.label[j]))
                        out.append((x.node[i], y.node[j]))
                cols = list(zip(*out, strict=True)) or [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return run


def _bag_arrays(size: int, wanted):
    """Expanded shingle hashes of the wanted documents: the j-th copy of a shingle has a hash of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_bitmap(wanted.value, tx.unsigned(b.column(2).to_numpy(zero_copy_only=False)))))
            for lo, hi, data, off in tx.chunks(*tx.utf8(b.column(1))):
                w = tx.words(data, off)
                row, item, weight = bags(w, size)
                copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                flat = tx.mix(np.repeat(item, weight) + copy.astype(np.uint64) * _LEVEL)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, weight, hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(tx.signed(prints(w))), pa.ListArray.from_arrays(pa.array(ends), pa.array(tx.signed(flat)))], ["doc_id", "node", "bag"])

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, registers: int = 80, bands: int = 20, filter_bits: int = 24, fan: int = 256) -> DataFrame:
    """One row per input row: doc_id, class_id (least id of its near-duplicate class), print (xxhash64 of its text).

    size: words of a shingle. threshold: least weighted Jaccard similarity of a link. registers, bands: a pair at 0.8
    shares no bucket with a probability of 3e-5. filter_bits: size of the bitmap of documents to compare.
    fan: texts that one copy of a central text is compared with.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(base.withColumn("print", F.xxhash64("text")).mapInArrow(_sign(size, registers, bands), "doc_id long, print long, node long, bands array<long>"), "signatures")
    texts = materialize(signed.where("doc_id is not null and node <> 0").groupBy("node").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("node", "x.*"), "texts")
    dealt = texts.select("node", "doc_id", F.posexplode("bands").alias("band", "key"))
    counts = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = dealt.join(counts, "key").groupBy("node", "doc_id").agg(F.sum("n").alias("central"), F.collect_list(F.struct("band", "key", "n")).alias("at"))
    live = materialize(live.select("node", "doc_id", "central", F.inline("at")), "live")
    hubs = live.groupBy("key").agg(F.max(F.struct("central", -F.col("doc_id"), "node")).alias("x")).select("key", F.col("x.node").alias("b"))
    starred = materialize(live.join(hubs, "key").where("node <> b").select("key", F.col("node").alias("a"), "b"), "starred")

    def bags_of(nodes: DataFrame) -> DataFrame:
        wanted = nodes.distinct().join(texts.select("node", "doc_id"), "node")
        bits = spark.sparkContext.broadcast(bitmap(wanted, F.xxhash64("doc_id"), filter_bits))
        bag = base.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("at")).mapInArrow(_bag_arrays(size, bits), "doc_id long, node long, bag array<long>")
        return materialize(bag.join(wanted.hint("shuffle_hash"), ["node", "doc_id"]).dropDuplicates(["node"]).select("node", "bag"), "bags")

    pairs = materialize(starred.select("a", "b").distinct().withColumn("part", F.abs(F.xxhash64("a"))), "pairs")
    bag = bags_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / fan).alias("parts"))
    dealt = pairs.join(parts, "b").select("a", "b", F.expr("part % parts").alias("part"))
    hub = bag.toDF("b", "bag_b").join(parts, "b").select("b", "bag_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = dealt.join(bag.toDF("a", "bag_a"), "a").join(hub, ["b", "part"]).select("a", "b", F.size(F.array_intersect("bag_a", "bag_b")).alias("s"), (F.size("bag_a") + F.size("bag_b")).alias("n"))
    links = materialize(both.where(F.col("s") >= threshold * (F.col("n") - F.col("s"))).select("a", "b"), "links")
    drop(bag, pairs)
    labels = components(links)

    label = labels.select("node", "label")
    classed = starred.join(label.toDF("a", "of_a"), "a", "left").join(label.toDF("b", "of_b"), "b", "left")
    odd = materialize(classed.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("key", F.col("a").alias("node")), "odd")
    if not odd.isEmpty():
        near = live.join(odd.select("key").distinct(), "key", "left_semi").select("node", "band", "key", F.expr("pmod(xxhash64(node), ceil(n / 64))").alias("part"))
        near = materialize(near, "near")
        bag = bags_of(near.select("node"))
        full = texts.select("node", "bands").join(bag, "node").join(label, "node", "left").select("node", F.struct("node", F.coalesce("label", "node").alias("label"), "bands", "bag").alias("x"))
        right = near.join(full, "node").groupBy("key", "band", "part").agg(F.collect_list("x").alias("right"))
        left = odd.join(near, ["key", "node"]).join(full, "node").groupBy("key", "part").agg(F.collect_list("x").alias("left"))
        more = materialize(left.select("key", "left").join(right, "key").select("band", "left", "right").mapInArrow(_block_links(bands, threshold), "a long, b long").distinct(), "more", batch_rows=8)
        drop(bag, near)
        if not more.isEmpty():
            labels = components(links.union(more))
        drop(more)
    drop(live, starred, links, odd)

    classes = texts.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    of = classes.join(least, "label").select("node", "class_id")
    every = signed.select("doc_id", "print", "node").where("node <> 0 and doc_id is not null").join(of, "node").select("doc_id", "class_id", "print")
    return every.unionByName(signed.where("node = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), "print"))

