"""Series functions as Catalyst expressions; a series is an ``array<double>`` column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column, f=lambda x: x) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def spread(v: Column, sample: bool = True) -> Column:
    """Standard deviation; 0 for one point or none if ``sample``."""
    n, mu = F.size(v), mean(v)
    square = F.aggregate(v, F.struct(F.lit(0.0).alias("s"), mu.alias("m")), lambda s, x: F.struct((s["s"] + (x - s["m"]) * (x - s["m"])).alias("s"), s["m"].alias("m")), lambda s: s["s"])
    return F.when(n <= 1, 0.0).otherwise(F.sqrt(square / (n - 1))) if sample else F.sqrt(square / n)


def scaled(v: Column, centre: Column, width: Column, mu: float = 0.0, std: float = 1.0) -> Column:
    """(x - centre) / width * std + mu, with both computed once for the series."""
    keep = F.array(F.struct(centre.alias("c"), width.alias("w")))
    return F.flatten(F.transform(keep, lambda k: F.transform(v, lambda x: (x - k["c"]) / k["w"] * std + mu)))


def scale_mean_variance(v: Column, mu: float = 0.0, std: float = 1.0) -> Column:
    """Mean mu and sample deviation std; a constant series is divided by 1e-8."""
    s = spread(v)
    return scaled(v, mean(v), F.when(s == 0, 1e-8).otherwise(s), mu, std)


def znorm_population(v: Column) -> Column:
    """Population scaling; a deviation up to 1e-8 keeps the values."""
    s = spread(v, sample=False)
    return F.when(s <= 1e-8, v).otherwise(scaled(v, mean(v), s))


def l2_norm(v: Column) -> Column:
    return F.sqrt(total(v, lambda x: x * x))


def shift(v: Column, by: int) -> Column:
    """out[i] = v[i - by], zero outside."""
    return F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.coalesce(F.get(v, i - by), F.lit(0.0)))


def windows(v: Column, m: int) -> Column:
    """All windows of length m, hop 1; none for a shorter series."""
    some = F.transform(F.sequence(F.lit(1), F.size(v) - m + 1), lambda i: F.slice(v, i, m))
    return F.when(F.size(v) >= m, some).otherwise(F.array().cast("array<array<double>>"))


def downsample(v: Column, factor: int) -> Column:
    return F.slice(F.filter(v, lambda x, i: i % factor == 0), F.lit(1), (F.size(v) / factor).cast("int"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def envelope(v: Column, radius: int) -> Column:
    """(low, high) of each point's neighbours within the radius."""

    def around(i: Column) -> Column:
        first = F.greatest(i - radius, F.lit(0))
        part = F.slice(v, first + 1, F.least(i + radius, F.size(v) - 1) - first + 1)
        return F.struct(F.array_min(part).alias("low"), F.array_max(part).alias("high"))

    return F.transform(F.sequence(F.lit(0), F.size(v) - 1), around)


def lb_keogh_to(query: Column, env: Column) -> Column:
    def excess(x: Column, e: Column) -> Column:
        d = F.when(x > e["high"], x - e["high"]).when(x < e["low"], e["low"] - x).otherwise(0.0)
        return d * d

    return F.sqrt(total(F.zip_with(query, env, excess)))


def lb_keogh(query: Column, candidate: Column, radius: int) -> Column:
    return lb_keogh_to(query, envelope(candidate, radius))


def lb_improved(a: Column, b: Column, radius: int) -> Column:
    """The larger of both directions."""
    return F.greatest(lb_keogh(a, b, radius), lb_keogh(b, a, radius))


def lb_yi(a: Column, b: Column) -> Column:
    d = lambda i: F.element_at(a, i) - F.element_at(b, i)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.sqrt(d(1) * d(1) + d(-1) * d(-1)))


def lb_paa(a: Column, b: Column, segments: int) -> Column:
    """Weighted distance of segment means: bounds the Euclidean distance, not DTW."""

    def part(k: Column) -> Column:
        first = (k * F.size(a) / segments).cast("int")
        n = ((k + 1) * F.size(a) / segments).cast("int") - first
        d = (total(F.slice(a, first + 1, n)) - total(F.slice(b, first + 1, n))) / n
        return F.when(n > 0, n * d * d).otherwise(0.0)

    return F.sqrt(total(F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), part)))


def best_match(v: Column, shapelet: Column) -> Column:
    """(distance, position) of the window nearest to the shapelet, first on ties; infinite and -1 if too short."""
    n = F.size(shapelet)
    at = F.transform(F.sequence(F.lit(0), F.size(v) - n), lambda i: F.struct(euclidean(F.slice(v, i + 1, n), shapelet).alias("distance"), i.alias("position")))
    return F.when(F.size(v) >= n, F.array_min(at)).otherwise(F.struct(F.lit(float("inf")).alias("distance"), F.lit(-1).alias("position")))


def distance_at(v: Column, shapelet: Column, offset: Column | int) -> Column:
    """Euclidean distance of a shapelet to the points of a series from ``offset`` on; null where they are too few."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    n = F.size(shapelet)
    return F.when((at >= 0) & (at + n <= F.size(v)), euclidean(F.slice(v, at + 1, n), shapelet))
