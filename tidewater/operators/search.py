"""Neighbour search and distance joins over collections of series."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import kernels as K
from ..functions import udfs as U

Metric = Callable[[Column, Column], Column]


def size_bytes(df: DataFrame, column: str = "values") -> int:
    """Bytes of all numbers of an array column, by one aggregate."""
    return 8 * int(df.agg(F.coalesce(F.sum(F.size(column) + 4), F.lit(0))).first()[0])


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many partitions as tasks can run at once, moved only if its source has fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def pairs(queries: DataFrame, series: DataFrame, broadcast_bytes: int = 32_000_000, envelope: int | None = None) -> DataFrame:
    """(query_id, query, series_id, values) of every query with every series, and both envelopes of a radius if asked.

    Queries of up to ``broadcast_bytes`` travel to the series, whose rows don't move. More are dealt into blocks of
    that size, and each block meets the series by an equality on the block, so no task holds all queries.
    """
    both = [] if envelope is None else [E.envelope(F.col("values"), envelope)]
    q = queries.select(F.col("series_id").alias("query_id"), F.col("values").alias("query"), *(e.alias("query_env") for e in both))
    s = series.select("series_id", "values", *(e.alias("env") for e in both))
    blocks = -(-size_bytes(queries) * (1 if envelope is None else 3) // broadcast_bytes)
    if blocks <= 1:
        return spread(s).crossJoin(F.broadcast(q))
    dealt = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    return s.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).join(dealt, "block").drop("block")


def top(df: DataFrame, k: int, by: str = "distance") -> DataFrame:
    """The k nearest series of each query with their rank; ties go to the smaller id."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy("query_id").orderBy(by, "series_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "series_id", by)


def knn(queries: DataFrame, series: DataFrame, k: int, radius: int | None = None, metric: Metric | None = None, others: bool = False, broadcast_bytes: int = 32_000_000) -> DataFrame:
    """k nearest by DTW (banded, if ``radius``) or by ``metric`` of two columns; a query excludes itself only with ``others``.

    A metric with a ``measure`` runs on arrays of the queries and each Arrow batch of series, as DTW does; other ones, and
    queries beyond ``broadcast_bytes``, on the rows of all pairs.
    """
    measure = K.dtw_measure(radius) if metric is None else getattr(metric, "measure", None)
    if k <= 0:
        raise ValueError("k must be positive")
    if measure is not None and whole_ids(queries, series) and size_bytes(queries) <= broadcast_bytes:
        return top(scan(collected(queries), series, k, measure, others=others), k)
    distance = metric or (lambda a, b: U.dtw(a, b, radius))
    both = pairs(queries, series, broadcast_bytes)
    both = both.where("query_id <> series_id") if others else both
    return top(both.select("query_id", "series_id", distance(F.col("query"), F.col("values")).alias("distance")), k)


def squared_bound(radius: int | None) -> Column:
    """A lower bound of squared-cost DTW of ``pairs``: from both ends and, for equal lengths, both envelopes."""
    a, b = F.col("query"), F.col("values")
    d = lambda i: F.element_at(a, i) - F.element_at(b, i)
    one = (F.size(a) == 1) & (F.size(b) == 1)
    ends = d(1) * d(1) + F.when(one, 0.0).otherwise(d(-1) * d(-1))
    if radius is None:
        return ends
    far = F.greatest(E.lb_keogh_to(a, F.col("env")), E.lb_keogh_to(b, F.col("query_env")))
    return F.when(F.size(a) == F.size(b), F.greatest(ends, far * far)).otherwise(ends)


def _envelopes(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest values within ``radius`` places, of each row."""
    low, high = x.copy(), x.copy()
    for d in range(1, min(radius, x.shape[1] - 1) + 1):
        low[:, d:], high[:, d:] = np.minimum(low[:, d:], x[:, :-d]), np.maximum(high[:, d:], x[:, :-d])
        low[:, :-d], high[:, :-d] = np.minimum(low[:, :-d], x[:, d:]), np.maximum(high[:, :-d], x[:, d:])
    return low, high


def _outside(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to an envelope, or of a row to envelopes."""
    return (np.maximum(0.0, np.maximum(x - high, low - x)) ** 2).sum(axis=-1)


class Rows:
    """Series of one length, also with time first and in single precision, for rough distances to a query."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.largest = x, float(np.abs(x).max()) if x.size else 0.0
        self.back = np.ascontiguousarray(x.T[::-1], np.float32) if self.largest < 1e15 else None
        self.whole: dict[float, np.ndarray] = {}

    def rough(self, query: np.ndarray, measure: K.Measure, some: np.ndarray, scale: float | None = None) -> np.ndarray:
        """Distances of the query to rows ``some`` in single precision; with ``scale``, of both times it in 16 bits."""
        whole = lambda v: np.rint(v * scale).astype(np.int64).astype(np.uint16)
        if scale is None:
            back, q, batch = self.back, query.astype(np.float32), measure.batch
        else:
            if scale not in self.whole:
                self.whole[scale] = whole(np.ascontiguousarray(self.x.T[::-1]))
            back, q, batch = self.whole[scale], whole(query), 2 * measure.batch
        back = back if len(some) == len(self.x) else back[:, some]
        n, m, q, out = len(query), len(back), q[None, :, None], np.empty(len(some), back.dtype)
        for lo in range(0, len(some), batch):
            b = np.ascontiguousarray(back[:, lo : lo + batch])[None, ::-1]
            size = b.shape[2]
            out[lo : lo + size] = measure.f(np.broadcast_to(q, (1, n, size)), b, np.full(size, n), np.full(size, m))
        return out

    def within(self, query: np.ndarray, measure: K.Measure, some: np.ndarray, limit: float, k: int | None = None) -> np.ndarray:
        """Those of the rows ``some`` that can be as near as ``limit``, or among the k nearest of them."""
        largest = max(self.largest, float(np.abs(query).max()))
        if measure.slack is None or self.back is None or not largest < 1e15 or not len(some):
            return some
        points = len(query) + self.x.shape[1]
        slack = lambda d: measure.slack(d, largest, points)
        if measure.coarse and 1e-12 < limit < 1e12 and len(some) > 256 and points < 512 and (measure.tried[0] < 100_000 or measure.tried[1] < 0.4 * measure.tried[0]):
            # Rounding both sides moves a difference by 1 at most, so the root of the sum by the root of the cells of a path.
            # Steps of the scale are few, and sums to three times the limit fit.
            scale = 2.0 ** (math.floor(16 * math.log2(math.sqrt(21_000 / limit))) / 16)
            if largest * scale < 1 << 40:
                near = self.rough(query, measure, some, scale) <= (scale * math.sqrt(limit) * (1 + 1e-9) + math.sqrt(points)) ** 2
                measure.tried[:] = measure.tried[0] + len(some), measure.tried[1] + int(near.sum())
                some, all_of = some[near], len(some)
                if len(some) < 0.15 * all_of:
                    return some
        rough = self.rough(query, measure, some)
        near = ~(rough > slack(limit))
        if k is not None and near.sum() > k:
            kth = float(np.partition(rough, k - 1)[k - 1])
            if np.isfinite(kth):
                near &= ~(rough > slack(slack(kth)))
        return some[near]


def exact(measure: K.Measure, queries: list[np.ndarray], rows: Rows, some: list[np.ndarray]) -> list[np.ndarray]:
    """Distances of each query to its own rows, in batches over all of them; queries of one length."""
    sizes = [len(s) for s in some]
    owner, at = np.repeat(np.arange(len(queries)), sizes), np.concatenate(some)
    q, out = np.stack(queries), np.empty(len(at))
    size = measure.batch // 2
    for lo in range(0, len(at), size):
        a, b = q[owner[lo : lo + size]].T, rows.x[at[lo : lo + size]].T
        out[lo : lo + size] = measure.f(np.ascontiguousarray(a)[None], np.ascontiguousarray(b)[None], np.full(a.shape[1], len(a)), np.full(a.shape[1], len(b)))
    return np.split(out, np.cumsum(sizes)[:-1])


class Nearest:
    """The k nearest series of one query among those seen: bounds first, then rough distances, and exact ones while they can win."""

    def __init__(self, query: np.ndarray, k: int, radius: int | None, measure: K.Measure | None = None) -> None:
        self.query, self.k, self.radius, self.measure = query, k, radius, measure or K.dtw_measure(radius)
        self.distance, self.id, self.computed = np.zeros(0), np.zeros(0, np.int64), 0
        self.low, self.high = _envelopes(query[None], radius) if radius is not None and len(query) else (None, None)

    @property
    def limit(self) -> float:
        return self.distance[-1] if len(self.distance) == self.k else np.inf

    def bounds(self, x: np.ndarray, low: np.ndarray | None, high: np.ndarray | None) -> np.ndarray:
        """Of DTW with rows of one length."""
        q = self.query
        out = (x[:, 0] - q[0]) ** 2
        if max(len(q), x.shape[1]) > 1:
            out = out + (x[:, -1] - q[-1]) ** 2
        if low is not None and x.shape[1] == len(q):
            out = np.maximum(out, np.maximum(_outside(q, low, high), _outside(x, self.low, self.high)))
        return out

    def take(self, ids: np.ndarray, d: np.ndarray) -> None:
        distance, owner = np.concatenate([self.distance, d]), np.concatenate([self.id, ids])
        best = np.lexsort((owner, distance))[: self.k]
        self.distance, self.id = distance[best], owner[best]

    def likely(self, rows: Rows, some: np.ndarray) -> np.ndarray:
        self.computed += len(some)
        return rows.within(self.query, self.measure, some, self.limit, self.k)

    def see(self, ids: np.ndarray, x: np.ndarray, bound: np.ndarray) -> None:
        rows, order, lo = Rows(x), np.lexsort((ids, bound)), 0
        while lo < len(order):
            size = K.BATCH if np.isinf(self.limit) else self.measure.batch
            some = order[lo : lo + size]
            some, lo = some[~(bound[some] > self.limit * (1 + 1e-9))], lo + size
            if not len(some):
                return
            some = self.likely(rows, some)
            if len(some):
                self.take(ids[some], exact(self.measure, [self.query], rows, [some])[0])


class Seen:
    """The nearest series of many queries among those a task sees.

    bounded: DTW bounds go first; that by envelopes stops when it rules out too few pairs to pay. cut: series are cut to
    the length of the query. others: a series of the query's own id doesn't count.
    """

    def __init__(self, asked: list[tuple[int, np.ndarray]], k: int, measure: K.Measure, radius: int | None, bounded: bool, cut: bool, others: bool) -> None:
        self.ids, self.cut, self.others, self.bounded = [i for i, _ in asked], cut, others, bounded
        self.all = [Nearest(v, k, radius if bounded else None, measure) for _, v in asked]
        self.measure, self.tested, self.out = measure, 0, 0
        self.labels: dict = {}

    def see(self, ids: np.ndarray, x: np.ndarray, labels: pa.Array | None) -> None:
        parts: dict[int, Rows] = {}
        envelopes = _envelopes(x, self.all[0].radius) if self.bounded and self.all and self.all[0].radius is not None else None
        every = np.arange(len(ids))
        for lo in range(0, len(self.all), 256):
            work, first = [], []
            for own, s in zip(self.ids[lo : lo + 256], self.all[lo : lo + 256], strict=True):
                size = min(x.shape[1], len(s.query)) if self.cut else x.shape[1]
                if size not in parts:
                    parts[size] = Rows(np.ascontiguousarray(x[:, :size]))
                rows, some, bound = parts[size], every[ids != own] if self.others else every, None
                if self.bounded:
                    paid = envelopes is not None and (self.tested < 100_000 or self.out > 0.4 * self.tested)
                    bound = s.bounds(x, *(envelopes if paid else (None, None)))
                    if np.isinf(s.limit) and len(some) > s.k:
                        near = np.argpartition(bound[some], s.k - 1)
                        first.append((s, rows, some[near[: s.k]]))
                        s.computed += s.k
                        some = some[near[s.k :]]
                work.append((s, rows, some, bound))
            self.settle(first, ids, labels)
            waiting, size = [], 0
            for s, rows, some, bound in work:
                if bound is not None:
                    left = some[~(bound[some] > s.limit * (1 + 1e-9))]
                    self.tested, self.out, some = self.tested + len(some), self.out + len(some) - len(left), left
                some = s.likely(rows, some)
                if len(some):
                    waiting.append((s, rows, some))
                    size += len(some)
                if size > 4096:
                    self.settle(waiting, ids, labels)
                    waiting, size = [], 0
            self.settle(waiting, ids, labels)

    def settle(self, waiting: list[tuple[Nearest, Rows, np.ndarray]], ids: np.ndarray, labels: pa.Array | None) -> None:
        groups: dict[tuple[int, int], list[tuple[Nearest, Rows, np.ndarray]]] = {}
        for w in waiting:
            groups.setdefault((len(w[0].query), w[1].x.shape[1]), []).append(w)
        for part in groups.values():
            for (s, _, some), d in zip(part, exact(self.measure, [w[0].query for w in part], part[0][1], [w[2] for w in part]), strict=True):
                s.take(ids[some], d)
                if labels is not None:
                    self.labels.update(zip(ids[some].tolist(), labels.take(pa.array(some)).to_pylist(), strict=True))


def whole_ids(*frames: DataFrame) -> bool:
    """Whether all series_id are of type long, which the array paths of the searches hold."""
    return all(df.schema["series_id"].dataType.simpleString() == "bigint" for df in frames)


def collected(queries: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Ids and values of queries, which must fit the driver."""
    asked = [(r["series_id"], np.array(r["values"], float)) for r in queries.select("series_id", "values").collect() if r["values"] is not None]
    if any(not len(v) for _, v in asked):
        raise ValueError("series must not be empty")
    return asked


def _ready(series: DataFrame, *more: str) -> DataFrame:
    return spread(series.where("values is not null").select(F.col("series_id").cast("long").alias("series_id"), F.col("values").cast("array<double>").alias("values"), *more))


def scan(asked: list[tuple[int, np.ndarray]], series: DataFrame, k: int, measure: K.Measure, radius: int | None = None, bounded: bool = False, cut: bool = False, others: bool = False, labelled: bool = False) -> DataFrame:
    """(query_id, series_id, distance, label if ``labelled``): the k nearest of each query as each task finds them among its series.

    Distances run in single precision first; those that its rounding can't rule out run again in double precision.
    """
    shared = series.sparkSession.sparkContext.broadcast(asked)
    label = series.select("label").schema["label"].dataType if labelled else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kind = Seen(shared.value, k, measure, radius, bounded, cut, others), None
        for b in batches:
            kind = b.schema.field(2).type if labelled else None
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                ids = part.column(0).to_numpy()
                for rows, x in of_length(part.column(1)):
                    seen.see(ids[rows], x, part.column(2).take(pa.array(rows)) if labelled else None)
        for lo in range(0, len(seen.all), 1024):
            some = seen.all[lo : lo + 1024]
            ids = np.concatenate([s.id for s in some])
            if len(ids):
                out = [pa.array(np.repeat(np.array(seen.ids[lo : lo + 1024], np.int64), [len(s.id) for s in some])), pa.array(ids), pa.array(np.concatenate([s.distance for s in some]))]
                extra = [pa.array([seen.labels[i] for i in ids.tolist()], kind)] if labelled else []
                yield pa.RecordBatch.from_arrays([*out, *extra], ["query_id", "series_id", "distance", *(["label"] if labelled else [])])

    more = ["label"] if labelled else []
    return _ready(series, *more).mapInArrow(run, "query_id long, series_id long, distance double" + (f", label {label.simpleString()}" if labelled else ""))


def of_length(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the series of each length; a null or empty series is an error."""
    sizes = values.value_lengths().to_numpy(zero_copy_only=False)
    if values.null_count or (len(sizes) and sizes.min() < 1):
        raise ValueError("series must not be empty")
    flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for n in np.unique(sizes).astype(int).tolist():
        at = np.flatnonzero(sizes == n)
        yield at, flat[(ends[at] - n)[:, None].astype(int) + np.arange(n)]


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and rows of the series of each length."""
    ids = batch.column(0).to_numpy()
    for at, x in of_length(batch.column(1)):
        yield ids[at], x


def knn_pruned(queries: DataFrame, series: DataFrame, k: int, radius: int | None = None, broadcast_bytes: int = 32_000_000) -> DataFrame:
    """As ``knn`` by DTW: each task keeps the k nearest of every query so far, and DTW runs only where a bound can win.

    Bounds and DTW share the Arrow batch that holds the series, so no series is shuffled; a window merges k rows of each
    query and task. Queries beyond ``broadcast_bytes`` go by all pairs, where the bound of the pair is tested against
    the k-th distance of the k pairs of the query with the smallest bounds.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if size_bytes(queries) > broadcast_bytes:
        bound = pairs(queries, series, broadcast_bytes, envelope=radius).withColumn("bound", squared_bound(radius)).drop("env", "query_env")
        order = Window.partitionBy("query_id").orderBy("bound", "series_id")
        seeds = bound.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
        limit = seeds.select("query_id", U.dtw("query", "values", radius).alias("d")).groupBy("query_id").agg(F.max("d").alias("limit"))
        rest = bound.join(limit, "query_id").where(F.col("bound") <= F.col("limit"))
        return top(rest.select("query_id", "series_id", U.dtw("query", "values", radius).alias("distance")), k)
    return top(scan(collected(queries), series, k, K.dtw_measure(radius), radius, bounded=True), k)


def crossed(queries: DataFrame, series: DataFrame, f: Callable[[np.ndarray, Rows], list[np.ndarray] | None], columns: str = "distance double", broadcast_bytes: int = 32_000_000) -> DataFrame:
    """(query_id, series_id, columns): f of each query and all series of a length, for every pair or, with the rows first, some.

    f(query, rows) gives the places of the rows and a value of each column for each. Queries beyond ``broadcast_bytes`` go
    to the series in turns, each of its own pass.
    """
    asked = queries.where("values is not null").select("series_id", "values")
    turns = max(1, -(-size_bytes(queries) // broadcast_bytes))
    names = ["query_id", "series_id", *(c.split()[0] for c in columns.split(", "))]

    def part(turn: int) -> DataFrame:
        mine = collected(asked if turns == 1 else asked.where(F.pmod(F.xxhash64("series_id"), F.lit(turns)) == turn))
        shared = series.sparkSession.sparkContext.broadcast(mine)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    for ids, x in by_length(b.slice(at, 2048)):
                        rows, out, size = Rows(x), [], 0
                        for n, (query, v) in enumerate(shared.value):
                            some, *values = f(v, rows)
                            out.append((np.full(len(some), query), ids[some], *values))
                            size += len(some)
                            if size >= 1 << 15 or (n == len(shared.value) - 1 and size):
                                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
                                out, size = [], 0

        return _ready(series).mapInArrow(run, f"query_id long, series_id long, {columns}")

    found = part(0)
    for turn in range(1, turns):
        found = found.unionByName(part(turn))
    return found


def measured(measure: K.Measure) -> Callable[[np.ndarray, Rows], list[np.ndarray]]:
    """For ``crossed``: the distance of every pair."""

    def f(query: np.ndarray, rows: Rows) -> list[np.ndarray]:
        some = np.arange(len(rows.x))
        return [some, exact(measure, [query], rows, [some])[0]]

    return f


def steps(query: np.ndarray, rows: Rows) -> list[np.ndarray]:
    """For ``crossed``: DTW and the cells of the path of every pair."""
    d, n = [], []
    for lo in range(0, len(rows.x), U.PAIRS):
        b = np.ascontiguousarray(rows.x[lo : lo + U.PAIRS].T)[None]
        size = b.shape[2]
        cost, count = K.warp(np.broadcast_to(query[None, :, None], (1, len(query), size)), b, np.full(size, len(query)), np.full(size, b.shape[1]), steps=True)
        d.append(cost)
        n.append(count)
    return [np.arange(len(rows.x)), np.concatenate(d), np.concatenate(n)]


def correlation(query: np.ndarray, rows: Rows) -> list[np.ndarray]:
    """For ``crossed``: the largest normalised cross-correlation of every pair, from one matrix product of all shifts of the query."""
    n = len(query)
    if rows.x.shape[1] != n:
        raise ValueError("series must have equal lengths")
    padded = np.concatenate([np.zeros(n - 1), query, np.zeros(n - 1)])
    shifts = np.lib.stride_tricks.sliding_window_view(padded, n)
    norm = np.linalg.norm(query) * np.linalg.norm(rows.x, axis=1)
    best = np.concatenate([(shifts @ rows.x[lo : lo + U.PAIRS].T).max(axis=0) for lo in range(0, len(rows.x), U.PAIRS)])
    return [np.arange(len(rows.x)), np.where(norm < 1e-9, 0.0, best / np.where(norm < 1e-9, 1.0, norm))]


def within(queries: DataFrame, series: DataFrame, limit: float, radius: int | None = None) -> DataFrame:
    """All series with DTW up to ``limit``: the bound by the ends is tested first, then rough distances, and the exact one."""
    measure = K.dtw_measure(radius)

    def f(query: np.ndarray, rows: Rows) -> list[np.ndarray]:
        near = rows.within(query, measure, np.flatnonzero(Nearest(query, 1, None).bounds(rows.x, None, None) <= limit * (1 + 1e-9)), limit)
        d = exact(measure, [query], rows, [near])[0] if len(near) else np.zeros(0)
        return [near[d <= limit], d[d <= limit]]

    if whole_ids(queries, series):
        return crossed(queries, series, f)
    near = pairs(queries, series, envelope=radius).where(squared_bound(radius) <= limit)
    return near.select("query_id", "series_id", U.dtw("query", "values", radius).alias("distance")).where(F.col("distance") <= limit)


def blocks(series: DataFrame, size: int = 2000, by: str | None = None) -> tuple[DataFrame, int]:
    """(by, n, block, rows): series in blocks of about ``size``, or of 100 at least for some 200 pairs of blocks in all, and the number of those."""
    key = [F.col(by)] if by else []
    rows = series.where("values is not null" + (f" and `{by}` is not null" if by else ""))
    counts = rows.groupBy(*key).count().withColumn("keys", F.count("*").over(Window.partitionBy(F.lit(0))))
    of = F.greatest(F.lit(1), F.least(F.ceil(20 / F.sqrt("keys")), F.ceil(F.col("count") / 100)), F.ceil(F.col("count") / size)).cast("int")
    counts = counts.select(*key, of.alias("n"))
    total = counts.agg(F.sum(F.col("n").cast("long") * (F.col("n") + 1) / 2)).first()[0] or 0
    joined = rows.join(F.broadcast(counts), by) if by else rows.crossJoin(F.broadcast(counts))
    at = F.pmod(F.xxhash64("series_id"), F.col("n")).cast("int")
    dealt = joined.select(*key, "n", at.alias("block"), F.struct(F.col("series_id").cast("long").alias("id"), F.col("values").cast("array<double>").alias("values"), *([F.col("label")] if "label" in series.columns else [])).alias("row"))
    return dealt.groupBy(*key, "n", "block").agg(F.collect_list("row").alias("rows")), int(total)


def block_pairs(series: DataFrame, f: Callable[[pa.Array, pa.Array, bool], Iterator[list]], columns: str, size: int = 2000, by: str | None = None) -> DataFrame:
    """(by, columns): f(rows, other rows, whether both are one block) of every pair of blocks of one value of ``by``.

    A pair of blocks is one row, so what moves is a series once for each block, and no pair of series.
    """
    all_of, total = blocks(series, size, by)
    cores = series.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(total, max(8 * cores, total // 4)))
    keep = [by] if by else []
    left = all_of.select(*keep, F.col("block").alias("p"), F.explode(F.sequence("block", F.col("n") - 1)).alias("q"), F.col("rows").alias("x"))
    right = all_of.select(*keep, F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), "block")).alias("p"), F.col("rows").alias("y"))
    both = left.repartition(parts, *keep, "p", "q").join(right.repartition(parts, *keep, "p", "q"), [*keep, "p", "q"])
    names = [*keep, *(c.split()[0] for c in columns.split(", "))]
    kind = f"`{by}` {series.schema[by].dataType.simpleString()}, " if by else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x, y = (b.column(c).slice(r, 1).flatten() for c in (b.num_columns - 2, b.num_columns - 1))
                one = b.column(b.num_columns - 4)[r].as_py() == b.column(b.num_columns - 3)[r].as_py()
                for out in f(x, y, one):
                    head = [pa.array([b.column(0)[r].as_py()] * len(out[0]), b.schema.field(0).type)] if by else []
                    yield pa.RecordBatch.from_arrays([*head, *map(pa.array, out)], names)

    return both.select(*keep, "p", "q", "x", "y").mapInArrow(run, kind + columns)


def _each_length(rows: pa.Array) -> list[tuple[np.ndarray, Rows]]:
    """Places and series of each length of a block."""
    return [(at, Rows(x)) for at, x in of_length(rows.field("values"))]


def _block_distances(measure: K.Measure, x: pa.Array, y: pa.Array, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of both sides and distances of all pairs of two blocks, or of one with itself, each pair once."""
    a, b = x.field("id").to_numpy(), y.field("id").to_numpy()
    for (at, xs), (to, ys) in itertools.product(_each_length(x), _each_length(y)):
        for lo in range(0, len(at), 64):
            mine = a[at[lo : lo + 64]]
            row, col = np.nonzero((b[to] > mine[:, None]) if one else (b[to] != mine[:, None]))
            if len(row):
                some = np.split(col, np.cumsum(np.bincount(row, minlength=len(mine)))[:-1])
                yield mine[row], b[to[col]], np.concatenate(exact(measure, list(xs.x[lo : lo + 64]), ys, some))


def self_distances(series: DataFrame, radius: int | None = None) -> DataFrame:
    """(id_a, id_b, distance), id_a < id_b: DTW of every pair of series."""
    measure = K.dtw_measure(radius)

    def f(x: pa.Array, y: pa.Array, one: bool) -> Iterator[list]:
        for a, b, d in _block_distances(measure, x, y, one):
            yield [np.minimum(a, b), np.maximum(a, b), d]

    return block_pairs(series, f, "id_a long, id_b long, distance double", 1000)


def self_mean(series: DataFrame, by: str, radius: int | None = None) -> DataFrame:
    """(by, mean, pairs): the mean DTW of all pairs of series of each value of ``by``."""
    measure = K.dtw_measure(radius)

    def f(x: pa.Array, y: pa.Array, one: bool) -> Iterator[list]:
        parts = [(d.sum(), len(d)) for _, _, d in _block_distances(measure, x, y, one)]
        if parts:
            yield [[math.fsum(t for t, _ in parts)], [sum(n for _, n in parts)]]

    sums = block_pairs(series, f, "total double, pairs long", 1000, by)
    return sums.groupBy(by).agg((F.sum("total") / F.sum("pairs")).alias("mean"), F.sum("pairs").alias("pairs"))


def _rough_matrix(xs: Rows, ys: Rows, measure: K.Measure) -> np.ndarray:
    """Distances of all pairs in single precision; several rows share a batch where the others are few."""
    x, b, n, m, size = xs.back[::-1], ys.back, len(xs.back), len(ys.back), len(ys.x)
    if size >= measure.batch:
        return np.stack([ys.rough(v, measure, np.arange(size)) for v in xs.x])
    out, group = np.empty((len(xs.x), size), np.float32), max(1, measure.batch // size)
    for lo in range(0, len(out), group):
        a = np.repeat(x[:, lo : lo + group], size, axis=1)[None]
        pairs = a.shape[2]
        out[lo : lo + group] = measure.f(a, np.tile(b, pairs // size)[None, ::-1], np.full(pairs, n), np.full(pairs, m)).reshape(-1, size)
    return out


def self_nearest(series: DataFrame, k: int, radius: int | None = None) -> DataFrame:
    """(series_id, train_id, label, distance): at least the k nearest others of every series of (series_id, values, label), by DTW.

    Every pair of blocks runs in single precision; of a row and of a column those stay that can be among its k nearest.
    """
    measure = K.dtw_measure(radius)
    label = series.schema["label"].dataType.simpleString()

    def f(x: pa.Array, y: pa.Array, one: bool) -> Iterator[list]:
        a, b = x.field("id").to_numpy(), y.field("id").to_numpy()
        for (at, xs), (to, ys) in itertools.product(_each_length(x), _each_length(y)):
            ids, others = a[at], b[to]
            largest, points = max(xs.largest, ys.largest), xs.x.shape[1] + ys.x.shape[1]
            open_ = ids[:, None] != others
            if xs.back is not None and ys.back is not None:
                rough = _rough_matrix(xs, ys, measure)
                rough[~open_] = np.inf
                slack = lambda d, largest=largest, points=points: np.array([measure.slack(v, largest, points) for v in d.tolist()])
                near = np.zeros(rough.shape, bool)
                for axis in (1, 0):
                    kth = np.partition(rough, k - 1, axis=axis).take(k - 1, axis=axis) if rough.shape[axis] > k else np.full(rough.shape[1 - axis], np.inf)
                    near |= ~(rough > np.expand_dims(slack(slack(kth)), axis))
                near &= open_
            else:
                near = open_
            row, col = np.nonzero(near)
            for lo in range(0, len(row), 1 << 14):
                r, c = row[lo : lo + (1 << 14)], col[lo : lo + (1 << 14)]
                part, at_row = np.unique(r, return_inverse=True)
                order = np.argsort(at_row, kind="stable")
                d = np.concatenate(exact(measure, list(xs.x[part]), ys, np.split(c[order], np.cumsum(np.bincount(at_row))[:-1])))
                r, c = at[r[order]], to[c[order]]
                yield [a[r], b[c], y.field("label").take(pa.array(c)), d]
                if not one:
                    yield [b[c], a[r], x.field("label").take(pa.array(r)), d]

    return block_pairs(series, f, f"series_id long, train_id long, label {label}, distance double")


def self_pairs(series: DataFrame, block: int = 500, by: str | None = None) -> DataFrame:
    """(by, id_a, a, id_b, b) with id_a < id_b, of one value of ``by`` if given.

    Blocks of series meet by equality on a pair of blocks, never all series, nor all of a large group, in one task.
    """
    n = max(1, -(-series.count() // block))
    at = F.pmod(F.xxhash64("series_id"), F.lit(n))
    keep = [by] if by else []
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = series.select(*keep, F.col("series_id").alias("id_a"), F.col("values").alias("a"), at.alias("p"), every.alias("q"))
    right = series.select(*keep, F.col("series_id").alias("id_b"), F.col("values").alias("b"), at.alias("q"), every.alias("p"))
    return left.join(right, [*keep, "p", "q"]).where("id_a < id_b").select(*keep, "id_a", "a", "id_b", "b")


def neighbours(series: DataFrame) -> DataFrame:
    """(id_a, a, id_b, b) of each series and the one with the next id."""
    a = series.select(F.col("series_id").alias("id_a"), F.col("values").alias("a"))
    b = series.select(F.col("series_id").alias("id_b"), F.col("values").alias("b"))
    return a.join(b, F.col("id_b") == F.col("id_a") + 1)
