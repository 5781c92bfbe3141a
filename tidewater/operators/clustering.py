"""Barycenters, k-means and k-Shape; only k centres ever come to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import kernels as K
from ..functions import udfs as U
from ..sources.series import check_equal_length
from .search import of_length, spread

CHUNK = 256


class EmptyClusterError(RuntimeError):
    """A cluster lost all its members."""


def euclidean_barycenter(df: DataFrame, *groups: str) -> DataFrame:
    """(groups, values): the point-wise mean."""
    points = df.select(*groups, F.posexplode("values").alias("t", "x")).groupBy(*groups, "t").agg(F.avg("x").alias("x"))
    return points.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("p")).select(*groups, F.transform("p", lambda p: p["x"]).alias("values"))


def _paths_sums(centre: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each point of a centre the sum of the points of the rows of x on its paths, and their number; last, of the distances."""
    out = np.zeros((2, len(centre) + 1))
    for lo in range(0, len(x), CHUNK):
        v = np.ascontiguousarray(x[lo : lo + CHUNK].T)
        n, m, size = len(centre), *v.shape
        cost, i, j = K.alignments(np.broadcast_to(centre[None, :, None], (1, n, size)), v[None], np.full(size, n), np.full(size, m))
        on = i >= 0
        out[0, :n] += np.bincount(i[on], v[j, np.arange(size)][on], n)
        out[1, :n] += np.bincount(i[on], minlength=n)
        out[:, n] += cost.sum(), size
    return out


def dba_step(df: DataFrame, centres: DataFrame, *groups: str) -> DataFrame:
    """One round of DTW barycenter averaging: (groups, values, cost), cost being the mean DTW to the old centre.

    Centres are few and go to every task; paths are walked there, ``CHUNK`` series at once, and a task gives a sum and a
    number for each point of a centre.
    """
    spark = df.sparkSession
    rows = centres.select(*groups, "values").collect()
    shared = spark.sparkContext.broadcast([np.array(r["values"], float) for r in rows])
    numbered = spark.createDataFrame([(*(r[g] for g in groups), n) for n, r in enumerate(rows)], StructType([*(centres.schema[g] for g in groups), StructField("__g", IntegerType())]))
    near = df.join(F.broadcast(numbered), list(groups)) if groups else df.withColumn("__g", F.lit(0))
    near = near.where("values is not null").select("__g", F.col("values").cast("array<double>").alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            group = b.column(0).to_numpy()
            for at, x in of_length(b.column(1)):
                for g in np.unique(group[at]).tolist():
                    part = _paths_sums(shared.value[g], x[group[at] == g])
                    sums[g] = sums[g] + part if g in sums else part
        for g, (s, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(s), pa.int32()), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s), pa.array(n)], ["__g", "t", "s", "n"])

    means = spread(near).mapInArrow(run, "__g int, t int, s double, n double").groupBy("__g", "t").agg((F.sum("s") / F.sum("n")).alias("x"))
    found = means.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda p: p["x"]).alias("x"))
    return found.join(F.broadcast(numbered), "__g").select(*groups, F.slice("x", F.lit(1), F.size("x") - 1).alias("values"), F.element_at("x", -1).alias("cost"))


def dba_barycenter(df: DataFrame, start: list[float] | None = None, max_iter: int = 100, tol: float = 1e-6, stop: str = "cost") -> tuple[list[float], float]:
    """The barycenter and its mean DTW, of a collection of any size: each round is one pass of partial sums.

    stop: "cost" ends when the cost moves less than ``tol`` and keeps the centre before; "shape", meant for large
    collections, ends when the root mean square move of the centre's points is less than ``tol`` and keeps the new one.
    """
    if stop not in ("cost", "shape"):
        raise ValueError(f"unknown stop {stop}")
    spark = df.sparkSession
    centre = start or euclidean_barycenter(df).first()["values"]
    cost = float("inf")
    for _ in range(max_iter):
        row = dba_step(df, spark.createDataFrame([(centre,)], "values array<double>")).first()
        if stop == "cost" and abs(cost - row["cost"]) < tol:
            return centre, row["cost"]
        moved = float(np.sqrt(np.mean((np.array(centre) - np.array(row["values"])) ** 2)))
        centre, cost = row["values"], row["cost"]
        if stop == "shape" and moved < tol:
            break
    return centre, cost


def assign(df: DataFrame, centres: list[list[float]], metric: str = "euclidean", radius: int | None = None) -> DataFrame:
    """Columns cluster and distance: the nearest centre, the first of equals; centres are k series, sent to every task."""
    return transform(df, centres, metric, radius).withColumn("near", F.array_min(F.transform("distances", lambda d, k: F.struct(d.alias("distance"), k.alias("cluster"))))).select("*", "near.cluster", "near.distance").drop("near", "distances")


def transform(df: DataFrame, centres: list[list[float]], metric: str = "euclidean", radius: int | None = None) -> DataFrame:
    """Column distances: to each centre."""
    literal = [F.array(*map(F.lit, map(float, c))) for c in centres]
    if metric == "euclidean":
        from ..functions.exprs import euclidean

        return df.withColumn("distances", F.array(*(euclidean(F.col("values"), c) for c in literal)))
    near = [np.array(c, float) for c in centres]
    if metric == "dtw":
        return df.withColumn("distances", _to_each(near, lambda x, c: K.dtw(np.ascontiguousarray(x.T)[None], np.broadcast_to(c[None, :, None], (1, len(c), len(x))), np.full(len(x), x.shape[1]), np.full(len(x), len(c)), radius))(F.col("values").cast("array<double>")))
    if metric == "sbd":
        return df.withColumn("distances", _to_each(near, lambda x, c: 1.0 - _correlations(x, c).max(axis=1))(F.col("values").cast("array<double>")))
    raise ValueError(f"unknown metric {metric}")


def _to_each(centres: list[np.ndarray], f: Callable) -> Callable[[Column], Column]:
    """A column function of the distances f(rows, centre) to each centre, ``CHUNK`` rows at once; of nulls for a null."""

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        out, good = np.zeros((len(v), len(centres))), np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
        for at, x in of_length(v.take(pa.array(good))):
            for lo in range(0, len(at), CHUNK):
                for k, c in enumerate(centres):
                    out[good[at[lo : lo + CHUNK]], k] = f(x[lo : lo + CHUNK], c)
        none = np.ones(len(v), bool)
        none[good] = False
        ends = np.arange(0, out.size + 1, len(centres), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel(), mask=np.repeat(none, len(centres))))

    return run


@dataclass(frozen=True)
class KMeansModel:
    centres: list[list[float]]
    inertia: float
    iterations: int
    metric: str = "euclidean"
    radius: int | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        return assign(df, self.centres, self.metric, self.radius)

    def transform(self, df: DataFrame) -> DataFrame:
        return transform(df, self.centres, self.metric, self.radius)


def _draw(seed: int, turn: int = 0):
    """A hash of the id that any engine can compute."""
    return F.md5(F.concat_ws(":", "series_id", F.lit(seed), F.lit(turn)))


@dataclass
class KMeans:
    """k-means under Euclidean distance or DTW. init: "k-means++", "random" or the k centres themselves.

    dtw_inertia: Euclidean assignment, but inertia by DTW. Of ``n_init`` runs the one of least inertia stays; runs that
    lose a cluster are left out, and an error if all do. Each round of Euclidean k-means is one pass.
    """

    k: int = 3
    max_iter: int = 100
    tol: float = 1e-6
    n_init: int = 1
    metric: str = "euclidean"
    radius: int | None = None
    barycenter_iter: int = 5
    init: str | list[list[float]] = "k-means++"
    seed: int = 0
    dtw_inertia: bool = False

    def start(self, df: DataFrame, seed: int) -> list[list[float]]:
        if not isinstance(self.init, str):
            return [list(map(float, c)) for c in self.init]
        if self.init not in ("random", "k-means++"):
            raise ValueError(f"unknown init {self.init}")
        order = _draw(seed)
        if self.init == "random":
            return [r["values"] for r in df.select("values", order.alias("o"), "series_id").groupBy("values").agg(F.min(F.struct("o", "series_id")).alias("o")).orderBy("o").limit(self.k).collect()]
        centres = [df.orderBy(order, "series_id").first()["values"]]
        while len(centres) < self.k:  # the weighted draw of a squared distance, as the largest of hashed exponential keys
            far = assign(df, centres, self.metric, self.radius)
            u = (F.conv(F.substring(_draw(seed, len(centres)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
            centres.append(far.orderBy(F.desc(F.when(F.col("distance") > 0, F.log(u) / (F.col("distance") * F.col("distance"))).otherwise(float("-inf"))), "series_id").first()["values"])
        return centres

    def cost(self, labelled: DataFrame, centres: list[list[float]]) -> DataFrame:
        """``labelled`` with the column cost: what a row adds to the inertia."""
        if not self.dtw_inertia or self.metric == "dtw":
            return labelled.withColumn("cost", F.col("distance"))
        own = F.get(F.array(*(F.array(*map(F.lit, map(float, c))) for c in centres)), F.col("cluster"))
        return labelled.withColumn("cost", U.dtw("values", own, self.radius))

    def step(self, df: DataFrame, centres: list[list[float]]) -> tuple[float, list[list[float]]]:
        """Inertia of the assignment to ``centres``, and the new ones."""
        labelled = self.cost(assign(df, centres, self.metric, self.radius), centres)
        if self.metric == "dtw":
            new = df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(centres)], "cluster int, values array<double>")
            for _ in range(self.barycenter_iter):
                rows = dba_step(labelled.select("cluster", "values"), new, "cluster").collect()
                new = df.sparkSession.createDataFrame([(r["cluster"], r["values"]) for r in rows], "cluster int, values array<double>")
            got, inertia = {r["cluster"]: r["values"] for r in rows}, labelled.agg(F.sum("cost")).first()[0]
        else:  # the cost rides behind the last point, so centres and inertia are one aggregate
            points = labelled.select("cluster", F.posexplode(F.concat("values", F.array("cost"))).alias("t", "x")).groupBy("cluster", "t").agg(F.sum("x").alias("s"), F.count("x").alias("n")).collect()
            size = len(centres[0])
            got, inertia = {}, sum(r["s"] for r in points if r["t"] == size)
            for r in points:
                if r["t"] < size:
                    got.setdefault(r["cluster"], [0.0] * size)[r["t"]] = r["s"] / r["n"]
        if len(got) < len(centres):
            raise EmptyClusterError(f"{len(centres) - len(got)} of {len(centres)} clusters are empty")
        return inertia, [got[k] for k in range(len(centres))]

    def run(self, df: DataFrame, seed: int) -> KMeansModel:
        centres, before, n = self.start(df, seed), None, 0
        for n in range(1, self.max_iter + 1):
            inertia, new = self.step(df, centres)
            if before is not None and abs(before - inertia) < self.tol:
                return KMeansModel(centres, inertia, n, self.metric, self.radius)
            before, centres = inertia, new
        inertia = self.cost(assign(df, centres, self.metric, self.radius), centres).agg(F.sum("cost")).first()[0]
        return KMeansModel(centres, inertia, n, self.metric, self.radius)

    def fit(self, df: DataFrame) -> KMeansModel:
        if self.k < 1:
            raise ValueError("k must be positive")
        check_equal_length(df)
        best, lost = None, None
        for turn in range(max(1, self.n_init)):
            try:
                model = self.run(df, self.seed + turn)
            except EmptyClusterError as e:
                lost = e
                continue
            if best is None or model.inertia < best.inertia:
                best = model
        if best is None:
            raise lost
        return best

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)


def _correlations(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    if x.shape[1] != len(centre):
        raise ValueError("series must have equal lengths")
    return K.ncc(x, np.tile(centre, (len(x), 1)))


def _aligned(values: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Rows moved to where they fit the centre best, with zeros coming in."""
    if not np.linalg.norm(centre):
        return values
    shifts = K.ncc(np.tile(centre, (len(values), 1)), values).argmax(axis=1) - (len(centre) - 1)
    at = np.arange(values.shape[1]) - shifts[:, None]
    inside = (at >= 0) & (at < values.shape[1])
    return np.where(inside, np.take_along_axis(values, np.where(inside, at, 0), axis=1), 0.0)


def _cluster_sums(members: DataFrame, old: list[np.ndarray], f: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Of each cluster the sum of f(cluster, aligned rows), an array; a task gives one for each, from ``CHUNK`` rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            cluster = b.column(0).to_numpy()
            for at, x in of_length(b.column(1)):
                for k in np.unique(cluster[at]).tolist():
                    mine = x[cluster[at] == k]
                    for lo in range(0, len(mine), CHUNK):
                        part = f(k, _aligned(mine[lo : lo + CHUNK], old[k])).ravel()
                        sums[k] = sums[k] + part if k in sums else part
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["cluster", "at", "v"])

    out: dict[int, np.ndarray] = {}
    rows = members.mapInArrow(run, "cluster int, at int, v double").groupBy("cluster", "at").agg(F.sum("v").alias("v")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v"))
    for r in rows.select("cluster", "v.v").collect():
        out[r["cluster"]] = np.array(r["v"])
    return out


def shape_extractions(labelled: DataFrame, centres: list[list[float]]) -> list[list[float]]:
    """The shape of each cluster: first eigenvector of the centred Gram matrix of its aligned members, by sign of the nearer.

    labelled: (cluster, values). All clusters share two passes; partial sums leave the tasks, never members.
    """
    n = len(centres[0])
    old = [np.array(c, float) for c in centres]
    members = labelled.where("values is not null").select("cluster", F.col("values").cast("array<double>").alias("values"))
    sums = _cluster_sums(members, old, lambda _, x: x.T @ x)
    if len(sums) < len(old):
        raise EmptyClusterError("an empty cluster has no shape")
    q = np.eye(n) - 1.0 / n
    shapes = [np.linalg.eigh(q @ sums[k].reshape(n, n) @ q)[1][:, -1] for k in range(len(old))]
    far = _cluster_sums(members, old, lambda k, x: np.array([np.linalg.norm(x - shapes[k], axis=1).sum(), np.linalg.norm(x + shapes[k], axis=1).sum()]))
    return [(-x if far[k][1] < far[k][0] else x).tolist() for k, x in enumerate(shapes)]


def shape_extraction(members: DataFrame, centre: list[float]) -> list[float]:
    """The shape of one cluster."""
    return shape_extractions(members.select(F.lit(0).alias("cluster"), "values"), [centre])[0]


def scale_pooled(centres: list[list[float]]) -> list[list[float]]:
    x = np.array(centres, float)
    s = x.std(ddof=1)
    return ((x - x.mean()) / (s or 1e-8)).tolist()


@dataclass
class KShape:
    """Clustering by shape-based distance; init are k centres, or else k series by hash, drawn anew for each run.

    Of ``n_init`` runs the one of least inertia stays. A run that loses a cluster is drawn again, up to ``retries``
    times in all; an error if no run succeeds.
    """

    k: int = 3
    max_iter: int = 100
    tol: float = 1e-6
    init: list[list[float]] | None = None
    seed: int = 0
    n_init: int = 1
    retries: int = 10

    def run(self, df: DataFrame, centres: list[list[float]]) -> KMeansModel:
        labelled = assign(df, centres, "sbd")
        before, n = labelled.agg(F.sum("distance")).first()[0], 0
        for n in range(1, self.max_iter + 1):
            new = scale_pooled(shape_extractions(labelled, centres))
            labelled = assign(df, new, "sbd")
            inertia = labelled.agg(F.sum("distance")).first()[0]
            if inertia > before or abs(before - inertia) < self.tol:
                if inertia <= before:
                    centres, before = new, inertia
                break
            centres, before = new, inertia
        return KMeansModel(centres, before, n, "sbd")

    def fit(self, df: DataFrame) -> KMeansModel:
        check_equal_length(df)
        best, done, lost = None, 0, None
        for turn in range(1 if self.init else max(self.n_init, self.retries)):
            start = self.init or KMeans(self.k, init="random").start(df, self.seed + turn)
            try:
                model = self.run(df, start)
            except EmptyClusterError as e:
                lost = e
                continue
            done += 1
            if best is None or model.inertia < best.inertia:
                best = model
            if done >= self.n_init:
                break
        if best is None:
            raise lost
        return best

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)
