"""Exact top-k by inner product with block-at-a-time pruning.

Rows lie in an order in which like vectors are neighbours: by the nearest of ``pivots`` vectors, which are those of
least hash, then by id. Document-range blocks of ``block`` rows keep their rows (the forward index) and the maximum and
minimum of each component (the term maxima). For a query, the sum over components of the larger of ``q * max`` and
``q * min`` bounds every score in the block; the ball around the block's mean gives a second bound, and the smaller of
both holds. Each query takes blocks in falling order of their bounds and stops when the next bound lies below its k-th
score so far.

Blocks travel in groups of ``group`` rows. First each query searches the group that holds it; the k-th score found
there is its floor. Then the batches of queries, with floors, meet the edges (term maxima and balls, a few hundred
bytes a block) of all other groups, and only a group with a block whose bound reaches the floor of one of a batch's
queries is sent to it and searched, from those floors on. No row is made per pair. A window over the query merges the best k of each group.
Order and pruning change the work only: on vectors without structure no bound lies below a floor and every block is
scored, as an exact search must.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; rows that repeat an
id are rows of their own, each the others' candidate; a null id is one too, after all others among equal scores; only
vectors of equal length are compared; ties go to the smaller id; a query with fewer than k candidates returns them
all. Products are summed in floats where these are exact, else in 64-bit integers, else in unbounded ones; components
and scores beyond 64 bits saturate.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

_BLOB = "dim int, part long, kind string, uids binary, ids binary, nulls binary, asks binary, x binary, top binary, low binary, centre binary, radius binary"
_ASKED = "g long, slice int, dim int, kind string, uids binary, ids binary, nulls binary, asks binary, x binary, floors binary, own array<struct<uid:bigint,query_id:bigint,vec_id:bigint,score:bigint>>"
_FOUND = "uid long, query_id long, vec_id long, score long"
_NONE = np.iinfo(np.int64).min
_ROOM = 22  # bits for the place of a row in its group


class Rows(NamedTuple):
    uid: np.ndarray
    id: np.ndarray
    null: np.ndarray  # whether the id is null
    asks: np.ndarray
    x: np.ndarray


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _raw(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def _small(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type."""
    size = max(-int(x.min(initial=0)), int(x.max(initial=0)))
    return x.astype(np.int8 if size < 1 << 7 else np.int16 if size < 1 << 15 else np.int32 if size < 1 << 31 else np.int64)


class Edges(NamedTuple):
    """Of blocks of rows: largest and least components, mean, and the largest distance from it."""

    top: np.ndarray
    low: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def edges(x: np.ndarray, block: int) -> Edges:
    starts = np.arange(0, len(x), block)
    size = np.diff(np.append(starts, len(x)))
    centre = np.add.reduceat(x.astype(np.float64), starts) / size[:, None]
    far = np.sqrt(((x - np.repeat(centre, size, axis=0)) ** 2).sum(axis=1))
    return Edges(np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts), centre, np.maximum.reduceat(far, starts))


def _pack(size: int, block: int):
    """Rows (dim, uid, id, asks, vector) in order into blobs of at most ``size`` rows of one dim, with their term maxima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Rows] = {}
        serial = 0

        def blob(dim: int, rows: Rows) -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            x = _small(rows.x)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([serial - 1]), pa.array([x.dtype.name]), *_raw(*rows[:4], x, *edges(x, block))], _names(_BLOB))

        for b in batches:
            dims, ids = b.column(0).to_numpy(), b.column(2)
            ends = np.cumsum(dims)
            flat = b.column(4).flatten().to_numpy()
            columns = b.column(1).to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                rows = Rows(*(c[at] for c in columns), flat[(ends[at] - dim)[:, None] + np.arange(dim)])
                if dim in held:
                    rows = Rows(*(np.concatenate(c) for c in zip(held.pop(dim), rows, strict=True)))
                while len(rows.uid) >= size:
                    yield blob(dim, Rows(*(c[:size] for c in rows)))
                    rows = Rows(*(c[size:] for c in rows))
                if len(rows.uid):
                    held[dim] = rows
        for dim, rows in held.items():
            yield blob(dim, rows)

    return run


def _rows(dim: int, kind: str, uids: bytes, ids: bytes, nulls: bytes, asks: bytes, x: bytes) -> Rows:
    return Rows(np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool), np.frombuffer(asks, bool), np.frombuffer(x, kind).reshape(-1, dim))


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, as int64; beyond 64 bits they saturate."""
    size = _largest(q) * _largest(x) * q.shape[1]
    if size < 1 << 53:
        kind = np.float32 if size < 1 << 24 else np.float64
        return (q.astype(kind) @ x.T.astype(kind)).astype(np.int64)
    if size < 1 << 63:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    info = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ x.T.astype(object), info.min, info.max).astype(np.int64)


def bounds(q: np.ndarray, of: Edges) -> np.ndarray:
    """For each query and block, a bound of the scores in it."""
    zero, info = np.int64(0), np.iinfo(np.int64)
    plus, minus = np.maximum(q, zero).astype(np.int64), np.minimum(q, zero).astype(np.int64)
    if _largest(q) * max(_largest(of.top), _largest(of.low)) * q.shape[1] * 2 < 1 << 62:
        terms = products(plus, of.top) + products(minus, of.low)
    else:
        terms = np.clip(plus.astype(object) @ of.top.T.astype(object) + minus.astype(object) @ of.low.T.astype(object), info.min, info.max).astype(np.int64)
    f = q.astype(np.float64)
    norm = np.sqrt((f**2).sum(axis=1))[:, None]
    ball = f @ of.centre.T + norm * of.radius
    ball += 1e-9 * norm * (np.sqrt((of.centre**2).sum(axis=1)) + of.radius) + 1  # above any rounding
    near = np.abs(ball) < 2.0**62
    return np.minimum(terms, np.where(near, np.where(near, ball, 0).astype(np.int64), np.where(ball > 0, info.max, -(1 << 62))))


def search_block(q: Rows, x: Rows, floors: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Best k rows of x for each query with scores of at least its floor: (query number, row of x, score), the k-th
    score of each query, and how many pairs of a query and a block were scored, of how many."""
    starts = np.arange(0, len(x.uid), block)
    bound = bounds(q.x, edges(x.x, block))
    order = np.argsort(~bound, axis=1, kind="stable")
    n, room = len(x.uid), np.int64(1 << _ROOM)
    place = np.empty(n, np.int64)  # of each row in order of id
    place[np.lexsort((x.uid, x.id, x.null))] = np.arange(n)
    row_of = np.argsort(place)
    narrow = _largest(q.x) * _largest(x.x) * q.x.shape[1] < 1 << 40  # score and place then share 64 bits
    score, rank = np.full((len(q.uid), k), _NONE), np.full((len(q.uid), k), n)
    floors, scored = floors.copy(), 0
    for turn in range(len(starts)):
        pick = order[:, turn]
        alive = bound[np.arange(len(pick)), pick] >= floors
        if not alive.any():
            break
        for b in np.unique(pick[alive]).tolist():
            rows = np.flatnonzero(alive & (pick == b))
            scored += len(rows)
            span = slice(int(starts[b]), int(starts[b]) + block)
            new = products(q.x[rows], x.x[span])
            free = (new >= floors[rows][:, None]) & (q.uid[rows][:, None] != x.uid[span])
            some = free.any(axis=1)
            rows, new, free = rows[some], new[some], free[some]
            if not len(rows):
                continue
            if narrow:
                keys = np.where(free, new * room + (room - 1 - place[span]), _NONE)
                best = np.partition(np.concatenate([score[rows], keys], axis=1), -k, axis=1)[:, -k:]
                score[rows] = best
                least = best.min(axis=1)
                floors[rows] = np.where(least > _NONE, np.maximum(floors[rows], least >> _ROOM), floors[rows])
            else:
                both = np.concatenate([score[rows], np.where(free, new, _NONE)], axis=1)
                places = np.concatenate([rank[rows], np.where(free, place[span], n)], axis=1)
                best = np.lexsort((places, ~both))[:, :k]
                score[rows], rank[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(places, best, 1)
                floors[rows] = np.where(rank[rows].max(axis=1) < n, np.maximum(floors[rows], score[rows].min(axis=1)), floors[rows])
    if narrow:
        rank = np.where(score > _NONE, room - 1 - (score & (room - 1)), n)
        score >>= _ROOM
    who, nth = np.nonzero(rank < n)
    return who, row_of[rank[who, nth]], score[who, nth], floors, scored, len(q.uid) * len(starts)


def _found(q: Rows, x: Rows, who: np.ndarray, row: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q.uid[who]), pa.array(q.id[who], mask=q.null[who]), pa.array(x.id[row], mask=x.null[row]), pa.array(score)], ["uid", "query_id", "vec_id", "score"])


def _lists(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)


def _own_group(k: int, block: int, batch: int):
    """Batches of a group's queries with their floors; the results in that group travel with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, dim, kind, *raw in _lists(b):
                x = _rows(dim, kind, *raw)
                asking = np.flatnonzero(x.asks)
                for at in range(0, len(asking), batch):
                    q = Rows(*(c[asking[at : at + batch]] for c in x))
                    *best, floors, _, _ = search_block(q, x, np.full(len(q.uid), _NONE), k, block)
                    own = _found(q, x, *best).to_struct_array()
                    yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([at // batch], pa.int32()), pa.array([dim], pa.int32()), pa.array([kind]), *_raw(*q, floors), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], _names(_ASKED))

    return run


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which (batch of queries, group) have a bound of at least a query's floor."""
    for b in batches:
        out = []
        for g, part, dim, kind, x, floors, h, h_kind, top, low, centre, radius in _lists(b):
            q = np.frombuffer(x, kind).reshape(-1, dim)
            of = Edges(*(np.frombuffer(raw, t).reshape(-1, dim) for raw, t in ((top, h_kind), (low, h_kind), (centre, np.float64))), np.frombuffer(radius, np.float64))
            if (bounds(q, of) >= np.frombuffer(floors, np.int64)[:, None]).any():
                out.append((g, part, h))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["g", "slice", "h"])


def _search(k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, floors, kind, *raw in _lists(b):
                q, x = _rows(dim, kind, *raw[:5]), _rows(dim, *raw[5:])
                yield _found(q, x, *search_block(q, x, np.frombuffer(floors, np.int64), k, block)[:3])

    return run


def _nearest(shared):
    """For each vector the number of the pivot of its length with the largest cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, ends, flat = b.column(0).to_numpy(), np.cumsum(b.column(0).to_numpy()), b.column(4).flatten().to_numpy().astype(np.float64)
            near = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                near[at] = (x @ shared.value[dim].T).argmax(axis=1) if dim in shared.value else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], [*b.schema.names, "pivot"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 128, group: int = 4096, batch: int = 512, pivots: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query.

    Components count as floor(scale * x). is_query: over the columns of ``vectors``. block, group: rows of a block and
    of a group of blocks. batch: queries of a matrix product. pivots: vectors whose neighbourhoods order the rows, a
    bounded sample that changes no result.
    """
    spark = vectors.sparkSession
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(good)
    rows = rows.select(F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("uid"), "id", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"), "asks")
    rows = materialize(rows, "vectors")
    chosen = rows.select("dim", "vector").orderBy(F.xxhash64("vector"), "vector").limit(pivots).collect()
    sample: dict[int, list] = {}
    for r in chosen:
        v = np.array(r["vector"], np.float64)
        sample.setdefault(r["dim"], []).append(v / (np.linalg.norm(v) or 1.0))
    shared = spark.sparkContext.broadcast({dim: np.stack(v) for dim, v in sample.items()})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = rows.select("dim", "uid", "id", "asks", "vector").mapInArrow(_nearest(shared), "dim int, uid long, id long, asks boolean, vector array<long>, pivot int")
    ordered = near.repartitionByRange(parts, "dim", "pivot", "uid").sortWithinPartitions("dim", "pivot", "uid")
    blobs = ordered.select("dim", "uid", "id", "asks", "vector").mapInArrow(_pack(group, block), _BLOB)
    groups = materialize(blobs.withColumn("g", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("part")).drop("part"), "groups")
    body = ["kind", "uids", "ids", "nulls", "asks", "x"]
    asked = materialize(groups.select("g", "dim", *body).mapInArrow(_own_group(k, block, batch), _ASKED), "asked", batch_rows=4)

    deals = F.lit(parts)  # batches are dealt, and each deal meets the term maxima of all groups
    batches = asked.select("g", "slice", "dim", "kind", "x", "floors", F.pmod(F.xxhash64("g", "slice"), deals).alias("deal"))
    limits = ["h_kind", "top", "low", "centre", "radius"]
    maxima = groups.select(F.col("g").alias("h"), "dim", F.col("kind").alias("h_kind"), *limits[1:], F.explode(F.sequence(F.lit(0).cast("long"), (deals - 1).cast("long"))).alias("deal"))
    met = batches.join(maxima, ["dim", "deal"]).where("g <> h").select("g", "slice", "dim", "kind", "x", "floors", "h", *limits)
    reached = materialize(met.mapInArrow(_reached, "g long, slice int, h long"), "reached")
    others = groups.select(F.col("g").alias("h"), *(F.col(c).alias(f"{c}_h") for c in body))
    pairs = reached.join(asked.drop("own"), ["g", "slice"]).join(others, "h").select("dim", "floors", *body, *(f"{c}_h" for c in body))
    found = materialize(pairs.repartition(max(parts, 1)).mapInArrow(_search(k, block), _FOUND), "found", batch_rows=4).unionByName(asked.select(F.inline("own")))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
