"""Matrix profiles, motifs and discords; windows are dealt in blocks, so a long series is many rows of work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .search import of_length

SHORT = 512  # windows of a series, up to which series of one length share their arrays
PROFILE = "series_id long, i int, distance double, nn_index int, left_distance double, left_index int, right_distance double, right_index int"


def _null(x: list[float]) -> list[float | None]:
    return [v if np.isfinite(v) else None for v in x]


def _dealt(df: DataFrame, size: Column, block: int) -> DataFrame:
    """``df`` with a row for each ``block`` windows of its series, the first of them in ``lo``; rows spread over the cluster."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(block))).otherwise(F.array().cast("array<int>")))
    return df.withColumn("lo", starts).repartition(parts, df.columns[0], "lo")


def matrix_profile(df: DataFrame, m: int, normalize: bool = False, exclusion: int | None = None, constant_infinite: bool = False, block: int = 4096) -> DataFrame:
    """One row per window: nearest window of the same series outside the exclusion zone; null where there is none.

    Each ``block`` windows of a series are a task's work of their own; a task holds the series, not its distances.
    """
    if m < 4:
        raise ValueError("windows must have 4 points at least")

    zone = m // 2 if exclusion is None else exclusion

    def rows(ids: np.ndarray, lo: int, p: dict) -> pa.RecordBatch:
        size = p["index"].shape[1]
        number = lambda k: pa.array(p[k].ravel(), mask=~np.isfinite(p[k].ravel()))
        index = lambda k: pa.array(p[k].ravel().astype(np.int32))
        head = [pa.array(np.repeat(ids, size)), pa.array(np.tile(np.arange(lo, lo + size, dtype=np.int32), len(ids)))]
        rest = [f(k) for f, k in ((number, "distance"), (index, "index"), (number, "left"), (index, "left_index"), (number, "right"), (index, "right_index"))]
        return pa.RecordBatch.from_arrays([*head, *rest], [c.split()[0] for c in PROFILE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts = b.column(0).to_numpy(), b.column(2).to_numpy()
            for at, x in of_length(b.column(1)):
                size = x.shape[1] - m + 1
                if zone >= 1 and size <= min(SHORT, block):
                    for lo in range(0, len(at), 256):
                        yield rows(ids[at[lo : lo + 256]], 0, K.profiles(x[lo : lo + 256], m, normalize, zone, constant_infinite))
                else:
                    for i, v in zip(at.tolist(), x, strict=True):
                        lo = int(starts[i])
                        p = K.matrix_profile(v, m, normalize, zone, None, constant_infinite, (lo, lo + block))
                        yield rows(ids[i : i + 1], lo, {k: np.array(c)[None] for k, c in p.items()})

    series = df.select(F.col("series_id").cast("long").alias("series_id"), F.col("values").cast("array<double>").alias("values"))
    return _dealt(series, F.size("values") - (m - 1), block).mapInArrow(run, PROFILE)


def ab_join(pairs: DataFrame, m: int, normalize: bool = False, block: int = 4096) -> DataFrame:
    """For pairs (id_a, a, id_b, b): each window of a with its nearest window of b, in blocks of windows of a."""

    def run(frames):
        for f in frames:
            for x, y, a, b, lo in zip(f["id_a"], f["id_b"], f["a"], f["b"], f["lo"], strict=True):
                if len(b) < m:
                    continue
                p = K.matrix_profile(a, m, normalize, None, b, normalize, (lo, lo + block))
                yield pd.DataFrame({"id_a": x, "id_b": y, "i": range(lo, lo + len(p["index"])), "distance": _null(p["distance"]), "nn_index": p["index"]})

    return _dealt(pairs.select("id_a", "id_b", "a", "b"), F.size("a") - (m - 1), block).mapInPandas(run, "id_a long, id_b long, i int, distance double, nn_index int")


def _greedy(df: DataFrame, f, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for frame in frames:
            out = [(sid, n, *x) for sid, d, i in zip(frame["series_id"], frame["d"], frame["nn"], strict=True) for n, x in enumerate(f(np.asarray(d, float), i), 1)]
            if out:
                yield pd.DataFrame(out, columns=names)

    whole = df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("i", "distance", "nn_index"))).alias("p"))
    return whole.select("series_id", F.col("p.distance").alias("d"), F.col("p.nn_index").alias("nn")).mapInPandas(run, schema)


def motifs(profile: DataFrame, k: int, zone: int) -> DataFrame:
    return _greedy(profile, lambda d, i: K.top_motifs(d, i, k, zone), "series_id long, rank int, index1 int, index2 int, distance double")


def discords(profile: DataFrame, k: int, zone: int) -> DataFrame:
    return _greedy(profile, lambda d, i: K.top_discords(d, k, zone), "series_id long, rank int, index int, distance double")


def multidimensional(profile: DataFrame) -> DataFrame:
    """Least distance over the dimensions of a series at each place, with the winning dimension; needs column dim."""
    best = profile.groupBy("series_id", "i").agg(F.min(F.struct("distance", "dim", "nn_index")).alias("x"))
    return best.select("series_id", "i", "x.distance", "x.dim", "x.nn_index")


def discord_thresholds(profile: DataFrame) -> DataFrame:
    """Statistics of the finite distances of each series and three thresholds."""
    d = profile.where("distance is not null").groupBy("series_id").agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"), F.array_sort(F.collect_list("distance")).alias("d"))
    n = F.size("d")
    return d.select("series_id", "mean", "std", F.get("d", (n / 2).cast("int")).alias("median"), F.get("d", F.floor(n * 0.95).cast("int")).alias("q95"), *((F.col("mean") + k * F.col("std")).alias(name) for name, k in (("conservative", 3), ("moderate", 2), ("aggressive", 1))))


def last_distances(x: np.ndarray, m: int) -> np.ndarray:
    """For each row, the distance of its last window to the nearest one that doesn't lie within m // 2 of it."""
    zone = max(1, m // 2)
    if x.shape[1] < m + zone:
        return np.full(len(x), np.inf)
    w = np.lib.stride_tricks.sliding_window_view(x, m, axis=1)
    return np.sqrt(((w[:, : w.shape[1] - zone] - w[:, -1:]) ** 2).sum(axis=2)).min(axis=1)


def last_distance(values: Column | str, m: int) -> Column:
    """Profile value of the last window; infinite without a neighbour. Series of one length share a batch of arrays."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        sizes = v.map(lambda x: 0 if x is None else len(x)).to_numpy()
        out = np.full(len(v), np.inf)
        for n in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == n)
            for lo in range(0, len(at), 1024):
                some = at[lo : lo + 1024]
                out[some] = last_distances(np.stack(v.iloc[some].to_list()).astype(float), m)
        return pd.Series(out)

    return run(values)


def streaming_twin(points: DataFrame, window: int, m: int, threshold: float, id_col: str, value_col: str, *order: str) -> DataFrame:
    """What the streaming detector flags, over a table: each point with the ``window + m`` newest points."""
    frame = Window.partitionBy(id_col).orderBy(*order).rowsBetween(-(window + m - 1), 0)
    rows = points.select(id_col, *order, F.collect_list(F.col(value_col).cast("double")).over(frame).alias("v"))
    d = F.when(F.size("v") >= window + m, last_distance("v", m))
    return rows.select(id_col, *order, d.alias("distance")).withColumn("flag", F.coalesce((F.col("distance") > threshold) & (F.col("distance") < float("inf")), F.lit(False)))
