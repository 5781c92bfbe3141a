"""Statistical features, nearest-neighbour and feature classifiers, and early classification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import exprs as E
from ..functions import kernels as K
from ..functions import udfs as U
from . import search as S
from . import shapelets as H

FEATURES = ("mean", "std", "min", "max", "median", "skew", "kurtosis", "slope", "variation", "acf1", "acf2", "energy", "complexity")


def series_features(v: Column) -> Column:
    """array<double> in the order of FEATURES. Moments divide by n with the sample deviation."""
    n = F.size(v)
    keep = F.array(F.struct(v.alias("v"), n.alias("n"), E.mean(v).alias("m"), E.spread(v).alias("s")))

    def rest(k: Column) -> Column:
        v, n, m, s = k["v"], k["n"], k["m"], k["s"]
        z = lambda p: F.when(s == 0, 0.0).otherwise(E.total(F.transform(v, lambda x: F.pow((x - m) / s, p))) / n)
        pairs = lambda lag: E.total(F.zip_with(F.slice(v, 1, n - lag), F.slice(v, lag + 1, n - lag), lambda x, y: (x - m) * (y - m)))
        acf = lambda lag: F.when((n <= lag) | (s == 0), 0.0).otherwise(pairs(lag) / (n - lag) / (s * s))
        t = F.sequence(F.lit(0), n - 1)
        sx, sxx = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
        sxy = E.total(F.zip_with(v, t, lambda x, i: x * i))
        slope = F.when(n < 2, 0.0).otherwise((n * sxy - sx * E.total(v)) / (n * sxx - sx * sx))
        ordered = F.array_sort(v)
        median = (F.get(ordered, ((n - 1) / 2).cast("int")) + F.get(ordered, (n / 2).cast("int"))) / 2
        moves = F.when(n < 2, 0.0).otherwise(E.total(F.zip_with(F.slice(v, 2, F.greatest(n - 1, F.lit(0))), F.slice(v, 1, F.greatest(n - 1, F.lit(0))), lambda x, y: F.abs(x - y))))
        return F.array(m, s, F.array_min(v), F.array_max(v), median, z(3), z(4) - F.when(s == 0, 0.0).otherwise(3.0), slope, F.when(m != 0, s / F.abs(m)).otherwise(0.0), acf(1), F.when(n > 2, acf(2)).otherwise(0.0), E.total(v, lambda x: x * x), moves)

    return F.get(F.transform(keep, rest), F.lit(0))


def class_stats(df: DataFrame, features: str = "features", sample: bool = False) -> DataFrame:
    """(label, mean, std): per class and feature, population deviations unless ``sample``."""
    spread = F.stddev_samp if sample else F.stddev_pop
    long = df.select("label", F.posexplode(features).alias("f", "x")).groupBy("label", "f").agg(F.avg("x").alias("mean"), F.coalesce(spread("x"), F.lit(0.0)).alias("std"))
    rows = long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("f", "mean", "std"))).alias("s"))
    return rows.select("label", F.transform("s", lambda x: x["mean"]).alias("mean"), F.transform("s", lambda x: x["std"]).alias("std"))


def feature_distance(features: Column, mean: Column, std: Column) -> Column:
    """Euclidean distance with each feature over its deviation; a deviation of 0 leaves it as it is."""
    parts = F.zip_with(F.zip_with(features, mean, lambda x, m: x - m), std, lambda d, s: F.when(s > 0, d / s).otherwise(d))
    return F.sqrt(E.total(parts, lambda d: d * d))


def softmax(df: DataFrame, key: str, distance: str = "distance") -> DataFrame:
    """Column p: exp(-d / max d) over its sum, uniform where that is undefined."""
    w = Window.partitionBy(key)
    score = F.exp(-F.col(distance) / F.max(distance).over(w))
    good = (F.max(distance).over(w) > 0) & (F.max(distance).over(w) < float("inf"))
    return df.withColumn("score", F.when(good, score).otherwise(1.0)).withColumn("p", F.col("score") / F.sum("score").over(w)).drop("score")


class Classifier(Protocol):
    """What an ensemble can hold. Series are rows (series_id, label, values); ids may be of any type."""

    name: str

    def fit(self, train: DataFrame) -> Classifier: ...

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """(series_id, label, p) for each row of (series_id, values)."""


def predict(probabilities: DataFrame) -> DataFrame:
    """(series_id, predicted): the label of the largest probability, the smaller of equals."""
    return probabilities.groupBy("series_id").agg(F.min(F.struct((-F.col("p")).alias("q"), "label")).alias("x")).select("series_id", F.col("x.label").alias("predicted"))


def classes(train: DataFrame) -> DataFrame:
    """(label, number): the distinct labels, numbered from 0 in their order; they are few."""
    rows = train.select("label").where("label is not null").distinct()
    return rows.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("number"))


@dataclass
class FeatureClassifier:
    """Distances of the statistical features to the class means, by softmax; class statistics are a small model."""

    name: str = "feature"
    stats: DataFrame | None = None

    def fit(self, train: DataFrame) -> FeatureClassifier:
        return FeatureClassifier(self.name, class_stats(train.select("label", series_features(F.col("values")).alias("features"))))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        scored = df.select("series_id", series_features(F.col("values")).alias("features")).crossJoin(F.broadcast(self.stats))
        return softmax(scored.select("series_id", "label", feature_distance(F.col("features"), F.col("mean"), F.col("std")).alias("distance")), "series_id").select("series_id", "label", "p")


def feature_probabilities(train: DataFrame, test: DataFrame) -> DataFrame:
    """(series_id, label, p) of each class for each test series."""
    return FeatureClassifier().fit(train).predict_proba(test)


@dataclass
class NearestNeighbours:
    """The k nearest training series, cut to the length of the series asked for, with weights 1 / (1 + d).

    metric: a function of two columns; banded DTW if none.
    """

    name: str = "neighbours"
    k: int = 5
    radius: int | None = 5
    metric: S.Metric | None = None
    train: DataFrame | None = field(default=None, repr=False)

    def fit(self, train: DataFrame) -> NearestNeighbours:
        if self.k < 1:
            raise ValueError("k must be positive")
        rows = train.where("label is not null and values is not null and size(values) > 0").select("series_id", "label", "values")
        if rows.isEmpty():
            raise ValueError("no training series")
        return NearestNeighbours(self.name, self.k, self.radius, self.metric, rows)

    def distances(self, df: DataFrame) -> DataFrame:
        """(series_id, train_id, label, distance) of all pairs."""
        asked = self.train.select(F.struct(F.col("series_id").alias("id"), "label").alias("series_id"), "values")
        both = S.pairs(asked, df)
        measure = self.metric or (lambda a, b: U.dtw(a, b, self.radius))
        cut = F.slice("query", F.lit(1), F.size("values"))
        return both.select("series_id", F.col("query_id.id").alias("train_id"), F.col("query_id.label").alias("label"), measure(F.col("values"), cut).alias("distance"))

    def nearest(self, df: DataFrame, broadcast_bytes: int = 32_000_000) -> DataFrame:
        """As ``distances``, of the k nearest at least: the series asked for go to the training series if they are few enough."""
        measure = K.dtw_measure(self.radius) if self.metric is None else getattr(self.metric, "measure", None)
        if measure is None or not S.whole_ids(self.train) or df.isStreaming or S.size_bytes(df) > broadcast_bytes:
            return self.distances(df)
        rows = df.where("values is not null").select("series_id", "values").collect()
        if any(not len(r["values"]) for r in rows):
            raise ValueError("series must not be empty")
        spark = df.sparkSession
        kind = StructType([StructField("query_id", LongType()), df.schema["series_id"]])
        keys = spark.createDataFrame([(n, r["series_id"]) for n, r in enumerate(rows)], kind)
        found = S.scan([(n, np.array(r["values"], float)) for n, r in enumerate(rows)], self.train, self.k, measure, cut=True, labelled=True)
        return found.withColumnRenamed("series_id", "train_id").join(F.broadcast(keys), "query_id").select("series_id", "train_id", "label", "distance")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return nearest_probabilities(self.nearest(df), self.k)


@dataclass
class ShapeletClassifier:
    """Distances to shapelets as features, class means and sample deviations, softmax of the scaled distance.

    shapelets: (candidate_id, values), or else the best at most 50 (half as many as training series) of lengths 3 to
    a quarter of the least series, or 10. A series shorter than a shapelet has equal probabilities of all classes.
    """

    name: str = "shapelet"
    shapelets: DataFrame | None = None
    limit: int = 10_000
    seed: int = 42
    stats: DataFrame | None = field(default=None, repr=False)

    def fit(self, train: DataFrame) -> ShapeletClassifier:
        chosen = self.shapelets
        if chosen is None:
            n, shortest = train.agg(F.count("*"), F.min(F.size("values"))).first()
            lengths = [m for m in range(3, max(10, (shortest or 0) // 4) + 1) if m < (shortest or 0)]
            if not lengths:
                raise ValueError("series are too short for shapelets")
            rows = H.fit(train, lengths, n=max(1, min(50, n // 2)), limit=self.limit, seed=self.seed)
            chosen = train.sparkSession.createDataFrame([(r["candidate_id"], r["values"]) for r in rows], "candidate_id string, values array<double>")
        stats = class_stats(self._features(train, chosen), sample=True)
        return ShapeletClassifier(self.name, chosen, self.limit, self.seed, stats)

    @staticmethod
    def _features(df: DataFrame, shapelets: DataFrame) -> DataFrame:
        rows = df if "label" in df.columns else df.withColumn("label", F.lit(None).cast("string"))
        found = H.distances(rows, shapelets).groupBy("series_id", "label").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "distance"))).alias("x"), F.count("*").alias("n"), F.count("distance").alias("whole"))
        return found.select("series_id", "label", F.when(F.col("n") == F.col("whole"), F.transform("x", lambda x: x["distance"])).alias("features"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        rows = self._features(df.select("series_id", "values"), self.shapelets).select("series_id", "features")
        both = rows.crossJoin(F.broadcast(self.stats))
        d = F.when(F.col("features").isNull(), 0.0).otherwise(feature_distance(F.col("features"), F.col("mean"), F.col("std")))
        return softmax(both.select("series_id", "label", d.alias("distance")), "series_id").select("series_id", "label", "p")


def nearest_probabilities(pairs: DataFrame, k: int = 5) -> DataFrame:
    """(series_id, label, p) from (series_id, train_id, label, distance): the k nearest, weight 1 / (1 + d)."""
    order = Window.partitionBy("series_id").orderBy("distance", "train_id")
    near = pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).where(F.col("distance") < float("inf"))
    votes = near.groupBy("series_id", "label").agg(F.sum(1.0 / (1.0 + F.col("distance"))).alias("w"))
    return votes.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("series_id"))).select("series_id", "label", "p")


def prefixes(df: DataFrame, shortest: int, step: int) -> DataFrame:
    """(series_id, label, t, n, values) for t = shortest, + step, ... within the series; the last is t >= n - step."""
    t = F.explode(F.when(F.size("values") >= shortest, F.sequence(F.lit(shortest), F.size("values"), F.lit(step))).otherwise(F.array().cast("array<int>")))
    rows = df.select("series_id", "label", F.size("values").alias("n"), "values", t.alias("t"))
    last = F.min(F.when(F.col("t") >= F.col("n") - step, F.col("t"))).over(Window.partitionBy("series_id"))
    return rows.withColumn("last", last).where("last is null or t <= last").select("series_id", "label", "t", "n", F.slice("values", F.lit(1), F.col("t")).alias("values"))


def confidence(p: Column) -> Column:
    """Gap between the two largest probabilities of an array; the only one itself; 0 for none."""
    best = F.sort_array(p, asc=False)
    return F.when(F.size(p) == 0, 0.0).when(F.size(p) == 1, F.get(best, F.lit(0))).otherwise(F.get(best, F.lit(0)) - F.get(best, F.lit(1)))


def aggregate(df: DataFrame, method: str, *keys: str) -> DataFrame:
    """(keys, label, p) over the members of an ensemble, from (keys, member, label, p); ties go to the smaller label."""
    if method not in ("average", "majority", "weighted", "max"):
        raise ValueError(f"unknown method {method}")
    if method == "average":
        return df.groupBy(*keys, "label").agg(F.avg("p").alias("p"))
    member = df.groupBy(*keys, "member").agg(confidence(F.collect_list("p")).alias("c"))
    if method == "weighted":
        both = df.join(member, [*keys, "member"])
        return both.groupBy(*keys, "label").agg(F.sum(F.col("p") * F.col("c")).alias("s"), F.sum("c").alias("w")).select(*keys, "label", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0).alias("p"))
    if method == "max":
        best = member.where("c > 0").groupBy(*keys).agg(F.min(F.struct(-F.col("c"), "member")).alias("x")).select(*keys, "x.member")
        return df.join(best, [*keys, "member"]).select(*keys, "label", "p")
    winners = df.groupBy(*keys, "member").agg(F.min(F.struct((-F.col("p")).alias("q"), "label")).alias("x")).groupBy(*keys, F.col("x.label").alias("label")).agg(F.count("*").alias("v"))
    every = df.select(*keys, "label").distinct().join(winners, [*keys, "label"], "left")
    return every.withColumn("p", F.coalesce("v", F.lit(0)) / F.sum("v").over(Window.partitionBy(*keys))).select(*keys, "label", "p")


def early_steps(p: DataFrame, rule: str = "confidence", threshold: float = 0.8, margin: float = 0.3) -> DataFrame:
    """One row per (series_id, t): top label, its probability, confidence, and whether the rule stops there.

    p: (series_id, t, label, p). Rules: confidence, margin, consensus (0.9), stabilization (after three steps, the top
    label's probability moved less than 0.05).
    """
    step = p.groupBy("series_id", "t").agg(F.min(F.struct((-F.col("p")).alias("q"), "label")).alias("x"), confidence(F.collect_list("p")).alias("confidence"), F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("probs"), F.count("*").alias("n"))
    order = Window.partitionBy("series_id").orderBy("t")
    step = step.select("series_id", "t", F.col("x.label").alias("label"), (-F.col("x.q")).alias("p"), "confidence", "n", F.lag("probs").over(order).alias("before"), F.row_number().over(order).alias("r"))
    stop = {
        "confidence": F.col("confidence") >= threshold,
        "margin": (F.col("n") >= 2) & (F.col("confidence") >= margin),
        "consensus": F.col("confidence") >= 0.9,
        "stabilization": (F.col("r") > 3) & (F.abs(F.col("p") - F.coalesce(F.col("before")[F.col("label")], F.lit(0.0))) < 0.05),
    }[rule]
    return step.select("series_id", "t", "label", "p", "confidence", stop.alias("stop"))


def early_results(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series_id, predicted, confidence, stopped, earliness): the first stop, or the last step."""
    end = F.coalesce(F.min(F.when(F.col("stop"), F.struct("t", "label", "p"))), F.max(F.struct("t", "label", "p")))
    out = steps.groupBy("series_id").agg(end.alias("x")).join(lengths.select("series_id", F.size("values").alias("n")), "series_id")
    return out.select("series_id", F.col("x.label").alias("predicted"), F.col("x.p").alias("confidence"), F.col("x.t").alias("stopped"), (1 - F.col("x.t") / F.col("n")).alias("earliness"))


@dataclass
class EarlyClassifier:
    """An ensemble that looks at growing prefixes of each series until its rule is sure.

    members: classifiers, fitted by ``fit``; those that can't be fitted drop out, and an error if none is left.
    aggregation: average, majority, weighted or max. rule: confidence, margin, consensus or stabilization. shortest,
    step: lengths of the prefixes; the last is the first that leaves less than a step. A series below ``shortest``
    gets the first class with confidence 0.
    """

    members: Sequence[Classifier] = ()
    aggregation: str = "average"
    rule: str = "confidence"
    threshold: float = 0.8
    margin: float = 0.3
    shortest: int = 10
    step: int = 1
    labels: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if not 0 < self.threshold <= 1 or not 0 <= self.margin <= 1 or self.shortest < 1 or self.step < 1:
            raise ValueError("thresholds must be shares, and lengths positive")
        if self.aggregation not in ("average", "majority", "weighted", "max") or self.rule not in ("confidence", "margin", "consensus", "stabilization"):
            raise ValueError("unknown aggregation or rule")

    def fit(self, train: DataFrame) -> EarlyClassifier:
        fitted = []
        for m in self.members:
            try:
                fitted.append(m.fit(train))
            except (ValueError, PySparkException):
                continue
        if not fitted:
            raise ValueError("no member could be fitted")
        return EarlyClassifier(fitted, self.aggregation, self.rule, self.threshold, self.margin, self.shortest, self.step, classes(train))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """(series_id, t, label, p) of the ensemble for every prefix."""
        rows = prefixes(df if "label" in df.columns else df.withColumn("label", F.lit(None).cast("string")), self.shortest, self.step)
        keyed = rows.select(F.struct("series_id", "t").alias("series_id"), "values")
        every = None
        for m in self.members:
            part = m.predict_proba(keyed).select("series_id.series_id", "series_id.t", F.lit(m.name).alias("member"), "label", "p")
            every = part if every is None else every.unionByName(part)
        return aggregate(every, self.aggregation, "series_id", "t")

    def steps(self, df: DataFrame) -> DataFrame:
        return early_steps(self.predict_proba(df), self.rule, self.threshold, self.margin)

    def predict(self, df: DataFrame) -> DataFrame:
        """(series_id, predicted, confidence, stopped, earliness) of each series."""
        seen = early_results(self.steps(df), df)
        brief = df.where(F.size("values") < self.shortest).crossJoin(F.broadcast(self.labels.agg(F.min("label").alias("predicted"))))
        n = F.size("values")
        return seen.unionByName(brief.select("series_id", "predicted", F.lit(0.0).alias("confidence"), F.lit(self.shortest).alias("stopped"), (1 - self.shortest / n).alias("earliness")))


def evaluate(results: DataFrame, truth: DataFrame) -> DataFrame:
    """accuracy, earliness, confidence, harmonic_mean."""
    a = results.join(truth.select("series_id", "label"), "series_id").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.avg("earliness").alias("earliness"), F.avg("confidence").alias("confidence"))
    both = 2 * F.col("accuracy") * F.col("earliness") / (F.col("accuracy") + F.col("earliness"))
    return a.withColumn("harmonic_mean", F.when((F.col("accuracy") == 0) | (F.col("earliness") == 0), 0.0).otherwise(both))


def dtw_dim_mean(a: Column, b: Column, features: int, radius: int = 5) -> Column:
    """Mean over features of the univariate banded DTW of array<array<double>> series."""
    part = lambda v, f: F.transform(v, lambda x: F.coalesce(F.get(x, f), F.lit(0.0)))
    total = None
    for f in range(features):
        d = U.dtw(part(a, f), part(b, f), radius)
        total = d if total is None else total + d
    return total / features
