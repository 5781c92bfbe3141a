"""Shapelets: candidates, quality, selection and the distance transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def valid(values: Column) -> Column:
    """Whether a shapelet holds a point at least and nothing but finite numbers."""
    return F.coalesce((F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def checked(shapelets: DataFrame) -> DataFrame:
    """``shapelets`` with an error for values that aren't valid; a null label is "unknown"."""
    values = F.when(valid(F.col("values")), F.col("values")).otherwise(F.raise_error(F.lit("a shapelet must hold finite numbers")).cast("array<double>"))
    out = shapelets.withColumn("values", values)
    return out.withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("unknown"))) if "label" in shapelets.columns else out


def distinct(shapelets: DataFrame) -> DataFrame:
    """One row of each identity: values, source and start; the least candidate_id remains."""
    order = Window.partitionBy("values", "source", "start").orderBy("candidate_id")
    return shapelets.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def normalized(values: Column) -> Column:
    """Population scaling of a shapelet."""
    return E.znorm_population(values)


def _draw(seed: int) -> Column:
    """A hash that any engine can compute, so a draw doesn't depend on the one that made it."""
    return F.md5(F.concat_ws(":", "source", "start", F.lit(seed)))


def windows_of(df: DataFrame, n: int) -> DataFrame:
    """(source, label, start, n, values) of every window of ``n`` points; those as long as their series are left out."""
    at = F.explode(F.when(F.size("values") > n, F.sequence(F.lit(0), F.size("values") - n - 1)).otherwise(F.array().cast("array<int>")))
    rows = df.select(F.col("series_id").alias("source"), "label", "values", at.alias("start"))
    return rows.select("source", "label", "start", F.lit(n).alias("n"), F.expr(f"slice(values, start + 1, {n})").alias("values"))


def candidates(df: DataFrame, lengths: list[int], limit: int = 10_000, seed: int = 0, balanced: bool = False) -> DataFrame:
    """(candidate_id, label, source, start, values): ``limit / lengths`` windows per length, by seeded hash; per label too if balanced.

    The windows are drawn by id, start and hash, by a limit in each task before any shuffle; only the drawn ones are
    cut out. Windows as long as their series are never drawn.
    """
    group = ["n", "label"] if balanced else ["n"]
    quota = max(1, limit // len(lengths))
    if balanced:
        quota = max(1, quota // max(1, df.select(F.countDistinct("label")).first()[0]))
    order = Window.partitionBy(*group).orderBy(_draw(seed), "source", "start")
    parts = None
    for n in lengths:
        part = windows_of(df, n).withColumn("r", F.row_number().over(order)).where(F.col("r") <= quota)
        parts = part if parts is None else parts.unionByName(part)
    return parts.select(F.concat_ws(":", "n", "source", "start").alias("candidate_id"), "label", "source", "start", "values")


def kmeans_candidates(df: DataFrame, lengths: list[int], limit: int, seed: int = 0, max_iter: int = 10) -> DataFrame:
    """Centres of Euclidean k-means over all windows of each length, ``limit / lengths`` of them, labelled "centroid"."""
    from .clustering import EmptyClusterError, KMeans

    quota, rows = max(1, limit // len(lengths)), []
    for n in lengths:
        points = windows_of(df, n).select(F.xxhash64("source", "start").alias("series_id"), "values")
        k = min(quota, points.select("values").distinct().limit(quota).count())
        if not k:
            continue
        try:
            centres = KMeans(k, max_iter=max_iter, init="random", seed=seed).fit(points).centres
        except EmptyClusterError:
            continue
        rows += [(f"{n}:centroid:{i}", "centroid", c) for i, c in enumerate(centres)]
    return df.sparkSession.createDataFrame(rows, "candidate_id string, label string, values array<double>")


def _match(shared):
    """Distance and first place of the best match of every shapelet in every series, length by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups = shared.value
        for b in batches:
            for row, v in enumerate(b.column(1)):
                x = np.asarray(v.values if v.is_valid else [], float)
                distance, place = np.full(len(ids), np.nan), np.full(len(ids), -1, np.int32)
                for at, s in groups:
                    n = s.shape[1]
                    if len(x) < n:
                        continue
                    w = np.lib.stride_tricks.sliding_window_view(x, n)
                    for lo in range(0, len(at), 512):
                        d = ((w[:, None, :] - s[lo : lo + 512]) ** 2).sum(axis=2)
                        some = at[lo : lo + 512]
                        place[some] = d.argmin(axis=0)
                        distance[some] = np.sqrt(d.min(axis=0))
                none = place < 0
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[row].as_py()] * len(ids), b.schema.field(0).type), pa.array(ids), pa.array(distance, mask=none), pa.array(place, mask=none)], ["series_id", "candidate_id", "distance", "position"])

    return run


def distances(df: DataFrame, shapelets: DataFrame, limit_bytes: int = 64_000_000) -> DataFrame:
    """(series_id, label, candidate_id, distance, position) of every series and shapelet, null where it is longer.

    Shapelets are a model: up to ``limit_bytes`` they go to every task, and each series meets them in one batch of
    arrays. More are joined to the series by built-in functions.
    """
    from .search import size_bytes, spread

    if size_bytes(shapelets) > limit_bytes:
        found = df.crossJoin(shapelets.select("candidate_id", F.col("values").alias("shapelet")))
        return found.select("series_id", "label", "candidate_id", E.best_match(F.col("values"), F.col("shapelet")).alias("x")).select("series_id", "label", "candidate_id", *(F.when(F.col("x.position") >= 0, F.col(f"x.{c}")).alias(c) for c in ("distance", "position")))
    rows = shapelets.select(F.col("candidate_id").cast("string").alias("candidate_id"), "values").orderBy("candidate_id").collect()
    sizes = np.array([len(r["values"]) for r in rows], int)
    if len(rows) and sizes.min() < 1:
        raise ValueError("a shapelet must hold finite numbers")
    groups = [(np.flatnonzero(sizes == n), np.array([r["values"] for r in rows if len(r["values"]) == n], float)) for n in np.unique(sizes).tolist()]
    shared = df.sparkSession.sparkContext.broadcast(([r["candidate_id"] for r in rows], groups))
    kind = df.schema["series_id"].dataType.simpleString()
    label = df.schema["label"].dataType.simpleString()
    keyed = spread(df.select(F.struct("series_id", "label").alias("s"), F.col("values").cast("array<double>").alias("values")))
    schema = f"series_id struct<series_id:{kind},label:{label}>, candidate_id string, distance double, position int"
    return keyed.mapInArrow(_match(shared), schema).select("series_id.series_id", "series_id.label", "candidate_id", "distance", "position")


def _gain(found: DataFrame) -> DataFrame:
    """Best gain of a midpoint threshold between the sorted distances of a candidate; 0 for a split with an empty side.

    With C the running counts of labels up to a distance, an entropy is log n minus the sum of C log C over n; both
    sums are running totals of what each row adds, so no task holds a candidate's rows.
    """
    log = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    label, whole = Window.partitionBy("candidate_id", "label"), Window.partitionBy("candidate_id")
    upto = whole.orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
    c, t = F.row_number().over(label.orderBy("distance")), F.count("*").over(label)
    rows = found.select("candidate_id", "label", "distance", c.alias("c"), t.alias("t"))
    rows = rows.select("candidate_id", "distance", (log(F.col("c")) - log(F.col("c") - 1)).alias("on"), (log(F.col("t") - F.col("c")) - log(F.col("t") - F.col("c") + 1)).alias("off"), F.when(F.col("c") == 1, log(F.col("t"))).otherwise(0.0).alias("all"))
    rows = rows.select("candidate_id", F.count("*").over(upto).alias("n"), F.sum("on").over(upto).alias("left"), F.sum("off").over(upto).alias("off"), F.sum("all").over(whole).alias("all"), F.count("*").over(whole).alias("size"))
    n, size = F.col("n"), F.col("size")
    entropy = lambda m, s: F.log2(m) - s / m
    gain = entropy(size, F.col("all")) - n / size * entropy(n, F.col("left")) - (size - n) / size * entropy(size - n, F.col("all") + F.col("off"))
    return rows.groupBy("candidate_id").agg(F.max(F.when(n < size, gain).when(size > 1, 0.0).otherwise(float("-inf"))).alias("quality"))


def quality(found: DataFrame, measure: str = "information_gain") -> DataFrame:
    """(candidate_id, quality) from distances and labels; rows without a distance don't count.

    information_gain: best midpoint split. f_statistic (also as kruskal_wallis). median_range: largest less smallest
    upper median of the classes (also as moods_median).
    """
    found = found.where("distance is not null")
    if measure == "information_gain":
        return _gain(found)
    if measure in ("median_range", "moods_median"):
        per = Window.partitionBy("candidate_id", "label")
        middle = found.select("candidate_id", "distance", F.row_number().over(per.orderBy("distance")).alias("r"), F.count("*").over(per).alias("n")).where("r = floor(n / 2) + 1")
        return middle.groupBy("candidate_id").agg(F.when(F.count("*") < 2, 0.0).otherwise(F.max("distance") - F.min("distance")).alias("quality"))
    if measure not in ("f_statistic", "kruskal_wallis"):
        raise ValueError(f"unknown measure {measure}")
    classes = found.groupBy("candidate_id", "label").agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), F.var_pop("distance").alias("var"))
    whole = found.groupBy("candidate_id").agg(F.avg("distance").alias("all"))
    s = classes.join(whole, "candidate_id").groupBy("candidate_id").agg(F.sum(F.col("n") * (F.col("mean") - F.col("all")) ** 2).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"), F.count("*").alias("c"), F.sum("n").alias("n"))
    b, w = F.col("between") / (F.col("c") - 1), F.col("within") / (F.col("n") - F.col("c"))
    return s.select("candidate_id", F.when((F.col("c") < 2) | (F.col("n") <= F.col("c")) | (F.col("within") <= 0), 0.0).otherwise(b / w).alias("quality"))


def select(scored: DataFrame, shapelets: DataFrame, n: int, threshold: float | None = 0.1) -> list[dict]:
    """The n best, without those nearer than ``threshold`` to a better one; n rows come to the driver. Qualities that agree to 9 places are ties, which go to the smaller id."""
    best = scored.orderBy(F.desc(F.round("quality", 9)), "candidate_id").limit(n)
    rows = [r.asDict() for r in best.join(shapelets, "candidate_id").orderBy(F.desc(F.round("quality", 9)), "candidate_id").collect()]
    kept: list[dict] = []
    for r in rows:
        v = np.array(r["values"])
        if threshold is None or not any(len(k["values"]) == len(v) and np.linalg.norm(np.array(k["values"]) - v) < threshold for k in kept):
            kept.append(r)
    return kept


def fit(df: DataFrame, lengths: list[int], n: int = 100, limit: int = 10_000, measure: str = "information_gain", threshold: float | None = 0.1, seed: int = 0, init: str = "random") -> list[dict]:
    """The best of the candidates that ``init`` draws: "random", "balanced" by class, or "kmeans"."""
    if init not in ("random", "balanced", "kmeans"):
        raise ValueError(f"unknown init {init}")
    drawn = kmeans_candidates(df, lengths, limit, seed) if init == "kmeans" else candidates(df, lengths, limit, seed, init == "balanced")
    drawn = drawn.persist()
    try:
        return select(quality(distances(df, drawn), measure), drawn, n, threshold)
    finally:
        drawn.unpersist()
