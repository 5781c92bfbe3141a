"""Language-model scores: a unigram base and a log-bilinear neural model trained by noise-contrastive estimation.

Counting covers every training text: partial counts of 64-bit word hashes, then one aggregate. The most frequent
``head`` words go to the executors (a fixed number); counts of all others reach the texts by a join.

The log-bilinear model predicts the next word's class from the two words before it:
``softmax(R1[u] C1 Qt + R2[v] C2 Qt + b)``. Each of the ``classes`` most frequent words is a class of its own; every
other word falls by its hash into one of ``buckets`` classes, which have embeddings like all classes, and takes its
share of the class by add-one counts. So each token's probability is normalised over all words and one unknown for
each bucket.

Training passes once over all training tokens. Documents are dealt by hash into shards of about ``shard_tokens``, so
the number of shards follows the data, never its partitions, and into ``rounds``. In a round each shard goes on from
the common parameters, by mini-batches with shared noise words, over its documents of that round in order of their
hashes, and gives the mean of its parameters over the second half of its steps; the mean of the shards by tokens, in
the order of a tree, is the common state of the next round. Partitions thus
don't change a score. For scoring, the products of the embeddings are tables over class pairs, and the normalisers of
all contexts come from batched matrix products, so a token costs a few look-ups. Each worker makes these tables once,
from the parameters; the driver never holds them.

Defined results: a null text is empty and has its end token alone; rows with a null id are training rows; rows that
repeat an id are scored one by one; an empty training set gives N = 0 and scores from add-one alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import drop, materialize

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
END = np.uint64(0x1F83D9ABFB41BD6B)


@dataclass
class Model:
    """heads: sorted hashes; counts of each; kind: class of each head word (-1 for those of the buckets)."""

    heads: np.ndarray
    counts: np.ndarray
    kind: np.ndarray
    singles: int  # classes of one word
    rest_log: np.ndarray  # log10 of each bucket's add-one denominator
    params: list[np.ndarray]

    @functools.cached_property
    def products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``tables`` of the parameters, once for each process that scores; they are many times larger."""
        return tables(self.params)


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with END after each row's words, and the rows' offsets."""
    w = tx.words(_LOWER[data], off)
    n = np.diff(w.bounds) + 1
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]), np.uint64)
    mask = np.ones(len(out), bool)
    mask[ends - 1] = False
    out[mask] = tx.word_hashes(w)
    out[~mask] = END
    return out, np.concatenate([[0], ends])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.add.reduceat(n, at)

    for b in batches:
        for _, _, data, off in tx.chunks(*tx.utf8(b.column(0))):
            keys, n = np.unique(_tokens(data, off)[0], return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(tx.signed(held[0][0])), pa.array(held[0][1])], ["h", "c"])
                    held = []
                size = sum(len(h[0]) for h in held)
    if held:
        keys, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(tx.signed(keys)), pa.array(n)], ["h", "c"])


def find(heads: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Position of each hash among the sorted heads, or -1."""
    if not len(heads):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(heads, h), len(heads) - 1)
    return np.where(heads[at] == h, at, -1)


def _classes(heads: np.ndarray, kind: np.ndarray, singles: int, buckets: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head position (or -1) and class of each token."""
    at = find(heads, h)
    now = np.where(at >= 0, kind[at], -1) if len(kind) else np.full(len(h), -1)
    return at, np.where(now >= 0, now, singles + bucket(h, buckets)).astype(np.int32)


def _before(now: np.ndarray, off: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; ``start`` stands before a text."""
    one, two = np.empty_like(now), np.empty_like(now)
    one[1:], two[2:] = now[:-1], now[:-2]
    one[off[:-1]] = two[off[:-1]] = start
    second = off[:-1] + 1
    two[second[second < off[1:]]] = start
    return one, two


def start_parameters(log_p: np.ndarray, dim: int, seed: int) -> list[np.ndarray]:
    """R1, R2 (with the start of a text), C1, C2, Q, b."""
    rng = np.random.default_rng(seed)
    n = len(log_p)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    eye = np.eye(dim, dtype=np.float32)
    return [draw(n + 1, dim), draw(n + 1, dim), eye.copy(), 0.5 * eye, draw(n, dim), log_p.astype(np.float32)]


def nce_step(params: list[np.ndarray], sums: list[np.ndarray], now: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, rate: float) -> None:
    """One mini-batch of noise-contrastive estimation with noise words shared by the batch, by Adagrad, in place."""
    r1, r2, c1, c2, q, bias = params
    k, n = len(noise), len(now)
    a, b = r1[one], r2[two]
    context = a @ c1 + b @ c2
    own = q[now]
    good = 1 / (1 + np.exp(np.clip(-((context * own).sum(axis=1) + bias[now] - log_noise[now] - np.log(k)), -30, 30))) - 1
    bad = 1 / (1 + np.exp(np.clip(-(context @ q[noise].T + bias[noise] - log_noise[noise] - np.log(k)), -30, 30)))
    d_context = good[:, None] * own + bad @ q[noise]
    grads = [np.zeros_like(p) for p in params]

    def scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        width = into.shape[1]
        into += np.bincount((rows[:, None] * width + np.arange(width)).ravel(), values.ravel(), into.size).reshape(into.shape)

    scatter(grads[0], one, d_context @ c1.T)
    scatter(grads[1], two, d_context @ c2.T)
    grads[2] += a.T @ d_context
    grads[3] += b.T @ d_context
    scatter(grads[4], now, good[:, None] * context)
    np.add.at(grads[4], noise, bad.T @ context)
    grads[5] += np.bincount(now, good, len(bias))
    np.add.at(grads[5], noise, bad.sum(axis=0))
    for p, s, g in zip(params, sums, grads, strict=True):
        g /= n
        s += g * g
        p -= rate * g / np.sqrt(s)


def _encode(setup, buckets: int):
    """(key, n, ids): the classes of each document's tokens as unsigned 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, kind, singles = setup.value
        for b in batches:
            for lo, hi, data, off in tx.chunks(*tx.utf8(b.column(1))):
                h, ends = _tokens(data, off)
                raw = _classes(heads, kind, singles, buckets, h)[1].astype("<u2").tobytes()
                ids = [raw[2 * x : 2 * y] for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(ends)), pa.array(ids, pa.binary())], ["key", "n", "ids"])

    return run


def _packed(arrays: list[np.ndarray]) -> bytes:
    return np.concatenate([x.ravel() for x in arrays]).astype(np.float32).tobytes()


def _unpacked(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    at = np.cumsum([0, *(x.size for x in like)])
    return [flat[a:b].reshape(x.shape).copy() for a, b, x in zip(at, at[1:], like, strict=False)]


def _train(state, log_p: np.ndarray, turn: int, seed: int, batch: int, k: int, rate: float):
    """One shard's training in a round: its tokens, the mean of its parameters over the second half, and squared gradients."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        params, sums = ([x.copy() for x in part] for part in state.value)
        shard = key[0].as_py()
        rng = np.random.default_rng([seed, turn, shard])
        rows = table.sort_by([("key", "ascending"), ("n", "ascending"), ("ids", "ascending")])
        now = np.frombuffer(b"".join(rows["ids"].to_pylist()), "<u2").astype(np.int32)
        one, two = _before(now, np.concatenate([[0], np.cumsum(rows["n"].to_numpy())]), len(log_p))
        weights = np.cumsum(np.exp(log_p))
        order = rng.permutation(len(now))
        means, steps, half = [np.zeros(x.shape) for x in params], 0, len(order) // 2
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            noise = np.minimum(np.searchsorted(weights, rng.random(k) * weights[-1]), len(log_p) - 1)
            nce_step(params, sums, now[some], one[some], two[some], noise, log_p, rate)
            if at + batch >= half:
                steps += 1
                for mean, x in zip(means, params, strict=True):
                    mean += x
        params = [mean / max(1, steps) for mean in means]
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(now)], pa.int64()), "state": pa.array([_packed([*params, *sums])], pa.binary())})

    return run


def _mean(rows: list[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
    """Tokens and their mean state, in the order of the rows."""
    n, total = 0, None
    for size, raw in rows:
        x = np.frombuffer(raw, np.float32).astype(np.float64) * size
        n, total = n + size, x if total is None else total + x
    return n, (total / max(1, n)).astype(np.float32)


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    rows = table.sort_by("shard")
    n, state = _mean(list(zip(rows["n"].to_pylist(), rows["state"].to_pylist(), strict=True)))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "state": pa.array([state.tobytes()], pa.binary())})


_STATE = "shard long, n long, state binary"


def mean_state(parts: DataFrame, shards: int, fan: int = 4) -> tuple[int, np.ndarray] | None:
    """Tokens and mean state of the shards' states, ``fan`` at a time, so neither a task nor the driver holds many."""
    while shards > fan:
        parts = parts.withColumn("shard", F.expr(f"shard div {fan}")).groupBy("shard").applyInArrow(_merge, _STATE)
        shards = -(-shards // fan)
    rows = sorted(parts.collect(), key=lambda r: r["shard"])
    return _mean([(r["n"], r["state"]) for r in rows]) if rows else None


def tables(params: list[np.ndarray], step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Products by the class before, then the class; by the class before that; the bias; the natural log of the normaliser, by both classes before.

    The normalisers come from matrix products of ``step`` classes by as many, so little is held beside the results.
    """
    r1, r2, c1, c2, q, bias = params
    one, two = ((r @ c @ q.T).astype(np.float32, copy=False) for r, c in ((r1, c1), (r2, c2)))
    weights = np.exp(bias.astype(np.float64) - bias.max())
    norm = np.empty((len(one), len(two)), np.float32)
    for y in range(0, len(two), step):
        high2 = two[y : y + step].max(axis=1)
        b = np.exp(two[y : y + step].astype(np.float64) - high2[:, None])
        for x in range(0, len(one), step):
            high1 = one[x : x + step].max(axis=1)
            a = np.exp(one[x : x + step].astype(np.float64) - high1[:, None])
            a *= weights
            low = (high1[:, None] + high2[None, :] + bias.max()).astype(np.float64)
            norm[x : x + step, y : y + step] = np.log(a @ b.T) + low
    return one, two, bias.astype(np.float32), norm


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        table1, table2, bias, norm = m.products
        log_c = np.log10(m.counts + 1.0)
        for b in batches:
            for lo, hi, data, off in tx.chunks(*tx.utf8(b.column(2))):
                h, ends = _tokens(data, off)
                at, now = _classes(m.heads, m.kind, m.singles, len(m.rest_log), h)
                one, two = _before(now, ends, len(bias))
                known = at >= 0
                base = np.where(known, log_c[at] if len(log_c) else 0.0, 0.0)
                own = (table1[one, now] + table2[two, now] + bias[now] - norm[one, two]).astype(np.float64) / np.log(10)
                own += np.where(now >= m.singles, base - m.rest_log[np.maximum(0, now - m.singles)], 0.0)
                tails = np.concatenate([[0], np.cumsum(~known)])
                lists = pa.ListArray.from_arrays(pa.array(tails[ends].astype(np.int32)), pa.array(tx.signed(h[~known])))
                cols = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(ends)), pa.array(np.add.reduceat(known.astype(np.int64), ends[:-1])), pa.array(np.add.reduceat(base, ends[:-1])), pa.array(np.add.reduceat(own, ends[:-1])), lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base", "own", "tail"])

    return run


def lm_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head: int = 65_536, classes: int = 1024, buckets: int = 1024, dim: int = 16, seed: int = 7, batch: int = 8192, noise: int = 64, rate: float = 0.02, rounds: int = 4, shard_tokens: int = 8_000_000) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held_out: rows to score but not to learn from. head: words whose counts go to every executor. classes: words with
    embeddings of their own. buckets: classes of all other words. dim: size of the embeddings. rounds: how often the
    shards' states are averaged. shard_tokens: about as many tokens make a shard; one task holds those of a round.
    """
    if classes + buckets >= 1 << 16:
        raise ValueError("classes are stored in 16 bits")
    spark = docs.sparkSession
    context = spark.sparkContext
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    train = base.where("not held_out")
    counts = materialize(train.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(size["n"]), int(size["v"])
    end = int(tx.signed(np.array([END]))[0])
    top = counts.where(F.col("h") != end).orderBy(F.desc("c"), "h").limit(head).toArrow()
    docs_seen = counts.where(F.col("h") == end).first()
    hashes, c = tx.unsigned(top["h"].to_numpy()), top["c"].to_numpy().astype(np.int64)
    if docs_seen:
        hashes, c = np.concatenate([[END], hashes]), np.concatenate([[docs_seen["c"]], c])
    singles = min(classes, len(hashes))
    kind = np.where(np.arange(len(hashes)) < singles, np.arange(len(hashes)), -1)
    order = np.argsort(hashes)
    heads, counted, kind = hashes[order], c[order], kind[order]
    mass, words = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in counts.groupBy(F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[r["b"]], words[r["b"]] = r["c"], r["n"]
    own = bucket(hashes[:singles], buckets)
    np.subtract.at(mass, own, c[:singles])
    np.subtract.at(words, own, 1)
    p = np.concatenate([c[:singles], mass]).astype(np.float64) + 1.0
    log_p = np.log(p / p.sum())
    params = start_parameters(log_p, dim, seed)
    if total:
        sums = [np.full_like(x, 1e-8) for x in params]
        shards = -(-total // shard_tokens)
        setup = context.broadcast((heads, kind, singles))
        keyed = train.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(_encode(setup, buckets), "key long, n long, ids binary")
        dealt = materialize(keyed.select("key", "n", "ids", F.pmod("key", F.lit(shards)).alias("shard"), F.pmod(F.shiftrightunsigned("key", 32), F.lit(rounds)).alias("turn")), "classes")
        for turn in range(rounds):
            state = context.broadcast((params, sums))
            parts = dealt.where(F.col("turn") == turn).select("shard", "key", "n", "ids").repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(_train(state, log_p, turn, seed, batch, noise, rate), _STATE)
            found = mean_state(parts, shards)
            if found and found[0]:
                fresh = _unpacked(found[1], [*params, *sums])
                params, sums = fresh[: len(params)], fresh[len(params) :]
        drop(dealt)
    model = Model(heads, counted, kind, singles, np.log10(mass + words + 1.0), params)
    scored = base.mapInArrow(_score(context.broadcast(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, tail array<long>")
    scored = materialize(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    tail = scored.select("uid", F.explode("tail").alias("h")).join(counts.hint("shuffle_hash"), "h")
    tail = tail.groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("hits"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return scored.drop("tail").join(tail.hint("shuffle_hash"), "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("hits")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("own") + zero("more")).alias("score"),
    )
