"""Arrow UDFs around the batch kernels, as DataFrame functions and for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import kernels as K


PAIRS = 512


class _Series:
    """The series of an Arrow column as one array of numbers with places; no row becomes a Python object."""

    def __init__(self, column: pa.Array, multivariate: bool) -> None:
        inner = column.type.value_type if pa.types.is_list(column.type) else None
        if multivariate and inner is not None:
            inner = inner.value_type if pa.types.is_list(inner) else None
        if inner != pa.float64():  # an untyped null, an empty array literal, or numbers of another type
            column = column.cast(pa.list_(pa.list_(pa.float64())) if multivariate else pa.list_(pa.float64()))
        self.good = column.is_valid().to_numpy(zero_copy_only=False)
        self.sizes = np.where(self.good, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        self.starts = column.offsets.to_numpy()[:-1].astype(np.int64)
        points, self.features = column.values, 1
        if multivariate:
            used = self.good & (self.sizes > 0)
            width = points.value_lengths().to_numpy(zero_copy_only=False)
            first = int(self.starts[used][0]) if used.any() else 0
            self.features = int(width[first]) if used.any() else 0
            inside = np.concatenate([np.arange(a, a + n) for a, n in zip(self.starts[used], self.sizes[used], strict=True)]) if used.any() and not (width == self.features).all() else []
            if len(inside):
                if not (width[inside] == self.features).all():
                    raise ValueError("all points must have one number of features")
                points, self.starts = points.take(pa.array(inside)), np.cumsum(np.where(used, self.sizes, 0)) - np.where(used, self.sizes, 0)
            points = points.flatten()
        self.flat = points.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, max(1, self.features))

    def stacked(self, rows: np.ndarray) -> np.ndarray:
        """(features, time, rows) with zeros at the end."""
        sizes = self.sizes[rows]
        t = np.arange(max(1, sizes.max(initial=1)))[:, None]
        if not len(self.flat):
            return np.zeros((max(1, self.features), len(t), len(rows)))
        x = self.flat[np.where(t < sizes, self.starts[rows] + t, 0)]
        return np.ascontiguousarray(np.where((t < sizes)[..., None], x, 0.0).transpose(2, 0, 1))


def _batches(a: pa.Array, b: pa.Array, f: Callable, multivariate: bool, size: int = PAIRS):
    """(rows, f of them) for parts of the pairs without a null; those of like length share a part."""
    x, y = _Series(a, multivariate), _Series(b, multivariate)
    if multivariate and x.features and y.features and x.features != y.features:
        raise ValueError("all points must have one number of features")
    good = np.flatnonzero(x.good & y.good)
    good = good[np.lexsort((y.sizes[good], x.sizes[good]))]
    for lo in range(0, len(good), size):
        some = good[lo : lo + size]
        xs, ys = x.stacked(some), y.stacked(some)
        if len(xs) != len(ys):  # one side holds no points
            xs, ys = (np.zeros((max(len(xs), len(ys)), *v.shape[1:])) if len(v) < max(len(xs), len(ys)) else v for v in (xs, ys))
        yield some, f(xs, ys, x.sizes[some], y.sizes[some])


def _numbers(a: pa.Array, b: pa.Array, f: Callable, multivariate: bool) -> pa.Array:
    out, none = np.zeros(len(a)), np.ones(len(a), bool)
    for rows, r in _batches(a, b, f, multivariate):
        out[rows], none[rows] = r, False
    return pa.array(out, mask=none)


def _distance(f: Callable, multivariate: bool = False):
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return _numbers(a, b, f, multivariate)

    return run


def _filled(n: np.ndarray, m: np.ndarray) -> None:
    if (n == 0).any() or (m == 0).any():
        raise ValueError("series must not be empty")


def dtw(a: Column | str, b: Column | str, radius: int | None = None, itakura: bool = False, threshold: float | None = None, multivariate: bool = False) -> Column:
    """Dynamic time warping: squared costs without a root; between points of several features rooted ones.

    radius: Sakoe-Chiba band. itakura: slopes from a half to 2. threshold: infinity as soon as a row's minimum is above.
    """
    if radius is not None and radius < 0:
        raise ValueError("the radius must not be negative")

    def f(x, y, n, m):
        _filled(n, m)
        return K.dtw(x, y, n, m, radius, itakura, threshold, multivariate)

    return _distance(f, multivariate)(a, b)


def dtw_path(a: Column | str, b: Column | str, multivariate: bool = False) -> Column:
    """struct(distance, path) with 0-based (i, j)."""

    @F.arrow_udf("distance double, path array<struct<i:int,j:int>>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        parts, rows = [pa.array([], pa.float64())], [np.zeros(0, int)]
        lists = [pa.array([], pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))]
        for some, (cost, i, j) in _batches(x, y, lambda *p: K.alignments(*p, rooted=multivariate), multivariate):
            i, j = i[::-1].T, j[::-1].T
            cells = pa.StructArray.from_arrays([pa.array(v[i >= 0].astype(np.int32)) for v in (i, j)], ["i", "j"])
            ends = np.concatenate([[0], np.cumsum((i >= 0).sum(axis=1))]).astype(np.int32)
            rows.append(some)
            parts.append(pa.array(cost))
            lists.append(pa.ListArray.from_arrays(pa.array(ends), cells, mask=pa.array(~np.isfinite(cost))))
        rows = np.concatenate(rows)
        at = np.zeros(len(x), int)
        at[rows] = np.arange(len(rows))
        none = np.ones(len(x), bool)
        none[rows] = False
        at = pa.array(at, mask=none)
        return pa.StructArray.from_arrays([pa.concat_arrays(v).take(at) for v in (parts, lists)], ["distance", "path"])

    return run(a, b)


def dtw_steps(a: Column | str, b: Column | str) -> Column:
    """struct(distance, steps): DTW and the cells of its path, of which only two anti-diagonals are kept."""

    @F.arrow_udf("distance double, steps int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        cost, steps, none = np.zeros(len(x)), np.zeros(len(x), np.int32), np.ones(len(x), bool)
        for rows, (d, n) in _batches(x, y, lambda *p: K.warp(*p, steps=True), False):
            cost[rows], steps[rows], none[rows] = d, n, False
        return pa.StructArray.from_arrays([pa.array(cost, mask=none), pa.array(steps, mask=none | ~np.isfinite(cost))], ["distance", "steps"])

    return run(a, b)


def lcss_length(a: Column | str, b: Column | str, epsilon: float = 0.1, delta: int = 1, multivariate: bool = False) -> Column:
    if epsilon < 0 or delta < 0:
        raise ValueError("epsilon and delta must not be negative")
    return _distance(lambda x, y, n, m: K.lcss(x, y, n, m, epsilon, delta), multivariate)(a, b)


def lcss(a: Column | str, b: Column | str, epsilon: float = 0.1, delta: int = 1, multivariate: bool = False) -> Column:
    """1 - LCS / longer length; two empty series are at 0 (at 1 with several features), an empty and another at 1."""
    longest = F.greatest(F.size(a), F.size(b))
    shared = lcss_length(a, b, epsilon, delta, multivariate)
    return F.when(longest == 0, 1.0 if multivariate else 0.0).when(F.least(F.size(a), F.size(b)) == 0, 1.0).otherwise(1.0 - shared / longest)


def msm(a: Column | str, b: Column | str, move: float = 1.0, split: float = 1.0, multivariate: bool = False) -> Column:
    return _distance(lambda x, y, n, m: K.msm(x, y, n, m, move, split), multivariate)(a, b)


msm.measure = K.msm_measure()


def twe(a: Column | str, b: Column | str, nu: float = 0.001, lam: float = 1.0, multivariate: bool = False) -> Column:
    return _distance(lambda x, y, n, m: K.twe(x, y, n, m, nu, lam), multivariate)(a, b)


def _correlated(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and correlations of the pairs of each length."""
    if (n != m).any():
        raise ValueError("series must have equal lengths")
    for size in np.unique(n).tolist():
        at = np.flatnonzero(n == size)
        yield at, K.ncc(x[0, :size, at], y[0, :size, at])


def ncc(a: Column | str, b: Column | str) -> Column:
    """Normalised cross-correlation for shifts -(n - 1)..n - 1 of two series of equal length."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out: list = [None] * len(x)
        for rows, parts in _batches(x, y, lambda *p: list(_correlated(*p)), False):
            for at, c in parts:
                for i, row in zip(rows[at].tolist(), c, strict=True):
                    out[i] = row
        return pa.array(out, pa.list_(pa.float64()))

    return run(a, b)


def _ncc_max(x, y, n, m) -> np.ndarray:
    out = np.zeros(len(n))
    for at, c in _correlated(x, y, n, m):
        out[at] = c.max(axis=1)
    return out


def ncc_max(a: Column | str, b: Column | str) -> Column:
    return _distance(_ncc_max)(a, b)


def best_shift(a: Column | str, b: Column | str) -> Column:
    """The shift of b that fits a best, the first of equals."""
    v = ncc(a, b)
    return (F.array_position(F.transform(v, lambda x: F.round(x, 12)), F.round(F.array_max(v), 12)) - 1).cast("int") - F.size(a) + 1


def custom(f: Callable, multivariate: bool = False) -> Callable[[Column | str, Column | str], Column]:
    """A distance of one's own as a column function: f(x, y, n, m) takes arrays (features, time, pairs), zero-padded, and
    the lengths of both sides, and gives one number for each pair. It fits every ``metric=`` argument."""
    return _distance(f, multivariate)


def register(spark: SparkSession) -> None:
    """Makes the distances callable from SQL with their default parameters, those of several features as ..._multivariate."""

    def dtw_filled(x, y, n, m, **options):
        _filled(n, m)
        return K.dtw(x, y, n, m, **options)

    def lcss_distance(empty):
        def f(x, y, n, m):
            longest = np.maximum(n, m)
            d = np.where(np.minimum(n, m) == 0, 1.0, 1.0 - K.lcss(x, y, n, m) / np.maximum(1, longest))
            return np.where(longest == 0, empty, d)

        return f

    plain = {
        "dtw": dtw_filled,
        "dtw_itakura": lambda *p: dtw_filled(*p, itakura=True),
        "lcss": lcss_distance(0.0),
        "lcss_length": K.lcss,
        "msm": K.msm,
        "twe": K.twe,
        "ncc_max": lambda x, y, n, m: K.ncc(x[0].T, y[0].T).max(axis=1),
        "sbd": lambda x, y, n, m: 1.0 - K.ncc(x[0].T, y[0].T).max(axis=1),
        "best_shift": lambda x, y, n, m: np.round(K.ncc(x[0].T, y[0].T), 12).argmax(axis=1) - (n - 1),
    }
    for name, f in plain.items():
        spark.udf.register(name, _distance(f))
    several = {"dtw": lambda *p: dtw_filled(*p, rooted=True), "lcss": lcss_distance(1.0), "msm": K.msm, "twe": K.twe}
    for name, f in several.items():
        spark.udf.register(f"{name}_multivariate", _distance(f, True))

    @F.arrow_udf("double")
    def dtw_sakoe_chiba(a: pa.Array, b: pa.Array, radius: pa.Array) -> pa.Array:
        out, none, radii = np.zeros(len(a)), np.ones(len(a), bool), radius.to_numpy(zero_copy_only=False).astype(float)
        for r in np.unique(radii[~np.isnan(radii)]).tolist():
            at = pa.array(np.flatnonzero(radii == r))
            got = _numbers(a.take(at), b.take(at), lambda *p, r=r: dtw_filled(*p, radius=int(r)), False)
            none[at], out[at] = got.is_null().to_numpy(zero_copy_only=False), got.fill_null(0.0).to_numpy(zero_copy_only=False)
        return pa.array(out, mask=none)

    spark.udf.register("dtw_sakoe_chiba", dtw_sakoe_chiba)
