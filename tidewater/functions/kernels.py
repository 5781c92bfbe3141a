"""Dynamic programs over batches of series pairs, in NumPy: all pairs of a batch move along anti-diagonals together.

Arrays are time first, pairs last; series of unequal length are padded and each pair is read at its own corner, which
depends on smaller indexes only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np

INF = np.inf
BATCH = 256


def wavefront(n: int, m: int, edge_i: np.ndarray, edge_j: np.ndarray, cell: Callable, end_i: np.ndarray, end_j: np.ndarray, fill: float = INF, keep: bool = False, rows: np.ndarray | None = None):
    """Cell (end_i, end_j) of each pair. edge_i, edge_j: costs of cells (i, 0) and (0, j).

    cell(lo, hi, k, diagonal, up, left) gives cells i = lo..hi of anti-diagonal k. keep: all diagonals are returned
    too. rows: gets the minimum of each row within the pair's own columns.
    """
    batch = len(end_i)
    out = np.full(batch, fill)
    before, last, trail = np.full((n + 1, batch), fill), np.full((n + 1, batch), fill), []
    for k in range(n + m + 1):
        now = np.full((n + 1, batch), fill)
        if k <= m:
            now[0] = edge_j[k]
        if 0 < k <= n:
            now[k] = edge_i[k]
        lo, hi = max(1, k - m), min(n, k - 1)
        if lo <= hi:
            now[lo : hi + 1] = cell(lo, hi, k, before[lo - 1 : hi], last[lo - 1 : hi], last[lo : hi + 1])
            if rows is not None:
                inside = (k - np.arange(lo, hi + 1))[:, None] <= end_j
                rows[lo : hi + 1] = np.minimum(rows[lo : hi + 1], np.where(inside, now[lo : hi + 1], INF))
        done = np.flatnonzero(end_i + end_j == k)
        out[done] = now[end_i[done], done]
        before, last = last, now
        if keep:
            trail.append(now)
    return (out, trail) if keep else out


def _mask(lo: int, hi: int, k: int, radius: int | None, itakura: bool) -> np.ndarray | None:
    i = np.arange(lo, hi + 1)
    j = k - i
    if radius is not None:
        return np.abs(i - j) > radius
    if itakura:
        return (j < 0.5 * i) | (j > 2.0 * i)
    return None


def _opposite(b: np.ndarray, lo: int, hi: int, k: int) -> np.ndarray:
    """b[j] with j = k - i (from 1) for i = lo..hi; ``b`` is reversed in time."""
    m = b.shape[-2]
    return b[..., m - k + lo : m - k + hi + 1, :]


def warp(a, b, end_i, end_j, radius=None, rooted=False, steps=False, moves=False):
    """DTW of (features, time, pairs) arrays in their own type; only cells of the band are computed, in place.

    In unsigned whole numbers, sums beyond the type start again from 0, so a result is never above the true one.

    steps: also the number of cells of each path. moves: also, by anti-diagonal from 2 and row, the step into each cell: 0
    the diagonal, 1 in b, 2 in a; ties prefer them in that order.
    """
    features, n, batch = a.shape
    m, kind = b.shape[1], a.dtype
    back = np.ascontiguousarray(b[:, ::-1])
    top = INF if kind.kind == "f" else np.iinfo(kind).max
    before, last, now = (np.full((n + 2, batch), top, kind) for _ in range(3))
    cost, near, more = np.empty((n, batch), kind), np.empty((n, batch), kind), np.empty((n, batch), kind) if features > 1 else None
    if steps:
        unit = np.uint8 if n + m < 256 else np.int32
        counts = [np.zeros((n + 2, batch), unit) for _ in range(3)]
    trail = np.zeros((max(0, n + m - 1), n + 2, batch), np.uint8) if moves else None
    before[0] = 0.0
    out, length = np.where((end_i == 0) & (end_j == 0), kind.type(0), kind.type(top)), np.zeros(batch, np.int32)
    good = (end_i > 0) & (end_j > 0) & (True if radius is None else np.abs(end_i - end_j) <= radius)
    ends = np.where(good, end_i + end_j, -1)
    done = {int(k): np.flatnonzero(ends == k) for k in np.unique(ends[good])}
    for k in range(2, max(done, default=1) + 1):
        lo, hi = max(1, k - m), min(n, k - 1)
        if radius is not None:
            lo, hi = max(lo, -(-(k - radius) // 2)), min(hi, (k + radius) // 2)
        if lo <= hi:
            c, t = cost[: hi - lo + 1], near[: hi - lo + 1]
            first, second = a[:, lo - 1 : hi], back[:, m - k + lo : m - k + hi + 1]
            np.subtract(first[0], second[0], out=c)
            np.multiply(c, c, out=c)
            for f in range(1, features):
                e = more[: hi - lo + 1]
                np.subtract(first[f], second[f], out=e)
                np.multiply(e, e, out=e)
                np.add(c, e, out=c)
            if rooted:
                np.sqrt(c, out=c)
            up, left, diagonal = last[lo - 1 : hi], last[lo : hi + 1], before[lo - 1 : hi]
            np.minimum(up, left, out=t)
            if steps or moves:
                straight, beside = diagonal <= t, left <= up
            if steps:  # a choice of one of two is a product with the mask, in whole numbers
                size = counts[2][lo : hi + 1]
                for mask, other, rest in ((beside, counts[1][lo : hi + 1], counts[1][lo - 1 : hi]), (straight, counts[0][lo - 1 : hi], size)):
                    np.add(rest, (other - rest) * mask.view(np.uint8).astype(unit, copy=False), out=size)
                size += unit(1)
            if moves:
                np.multiply(np.logical_not(straight).view(np.uint8), np.uint8(2) - beside.view(np.uint8), out=trail[k - 2, lo : hi + 1])
            np.minimum(t, diagonal, out=t)
            np.add(c, t, out=now[lo : hi + 1])
        now[lo - 1], now[hi + 1] = top, top
        if k in done:
            out[done[k]] = now[end_i[done[k]], done[k]]
            if steps:
                length[done[k]] = counts[2][end_i[done[k]], done[k]]
        before, last, now = last, now, before
        if steps:
            counts = [counts[1], counts[2], counts[0]]
    return (out, *((length,) if steps else ()), *((trail,) if moves else ())) if steps or moves else out


def dtw(a, b, end_i, end_j, radius=None, itakura=False, threshold=None, rooted=False):
    """DTW of (features, time, pairs) arrays; squared costs, or rooted Euclidean ones between points."""
    if not itakura and threshold is None:
        return warp(a, b, end_i, end_j, radius, rooted)
    n, m, batch = a.shape[1], b.shape[1], a.shape[2]
    back = b[:, ::-1]

    def cell(lo, hi, k, diagonal, up, left):
        cost = ((a[:, lo - 1 : hi] - _opposite(back, lo, hi, k)) ** 2).sum(axis=0)
        if rooted:
            cost = np.sqrt(cost)
        out = cost + np.minimum(np.minimum(up, left), diagonal)
        hole = _mask(lo, hi, k, radius, itakura)
        if hole is not None:
            out[hole] = INF
        return out

    edge = lambda size: np.vstack([np.zeros((1, batch)), np.full((size, batch), INF)])
    rows = np.full((n + 1, batch), INF) if threshold is not None else None
    out = wavefront(n, m, edge(n), edge(m), cell, end_i, end_j, rows=rows)
    if rows is not None:
        over = (rows > threshold) & (np.arange(n + 1)[:, None] >= 1) & (np.arange(n + 1)[:, None] <= end_i)
        out = np.where(over.any(axis=0), INF, out)
    return out


def alignments(a, b, end_i, end_j, **options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances, and the places in a and b of the path's cells from its end (cells, pairs); -1 past its start, or if infinite."""
    cost, trail = warp(a, b, end_i, end_j, moves=True, **options)
    pair = np.arange(len(cost))
    i, j = np.where(np.isfinite(cost), end_i, 0), np.where(np.isfinite(cost), end_j, 0)
    in_a, in_b = [], []
    while True:
        on = (i > 0) & (j > 0)
        if not on.any():
            break
        in_a.append(np.where(on, i - 1, -1))
        in_b.append(np.where(on, j - 1, -1))
        go = trail[np.where(on, i + j - 2, 0), i, pair]
        i, j = i - (on & (go != 1)), j - (on & (go != 2))
    none = np.zeros((0, len(cost)), int)
    return cost, np.array(in_a) if in_a else none, np.array(in_b) if in_b else none


def dtw_paths(a, b, end_i, end_j, **options) -> tuple[np.ndarray, list[list[tuple[int, int]] | None]]:
    """Distances and alignment paths from 0; ties prefer the diagonal, then a step in b, then one in a; no path if infinite."""
    cost, in_a, in_b = alignments(a, b, end_i, end_j, **options)
    paths: list[list[tuple[int, int]] | None] = []
    for p in range(len(cost)):
        n = int((in_a[:, p] >= 0).sum())
        paths.append(list(zip(in_a[n - 1 :: -1, p].tolist(), in_b[n - 1 :: -1, p].tolist(), strict=True)) if n else [] if np.isfinite(cost[p]) else None)
    return cost, paths


def lcss(a, b, end_i, end_j, epsilon=0.1, delta=1):
    """Length of the longest common subsequence within ``epsilon`` and ``delta`` steps."""
    n, m, batch = a.shape[1], b.shape[1], a.shape[2]
    back = b[:, ::-1]

    def cell(lo, hi, k, diagonal, up, left):
        same = (np.abs(a[:, lo - 1 : hi] - _opposite(back, lo, hi, k)) <= epsilon).all(axis=0)
        i = np.arange(lo, hi + 1)[:, None]
        same &= np.abs(2 * i - k) <= delta
        return np.where(same, diagonal + 1, np.maximum(up, left))

    return wavefront(n, m, np.zeros((n + 1, batch)), np.zeros((m + 1, batch)), cell, end_i, end_j, fill=0.0)


def msm(a, b, end_i, end_j, move=1.0, split=1.0):
    """Move-split-merge, the library's variant: moves scale with the difference, splits and merges add a tenth of it."""
    total = np.zeros(a.shape[2])
    for x, y in zip(a, b, strict=True):
        n, m, batch = len(x), len(y), x.shape[1]
        past_x, past_y = np.concatenate([x[:1], x[:-1]]), np.concatenate([y[:1], y[:-1]])
        back, back_past = np.ascontiguousarray(y[::-1]), np.ascontiguousarray(past_y[::-1])
        before, last, now = (np.full((n + 1, batch), INF, x.dtype) for _ in range(3))
        moved, divided, merged, some = (np.empty((n, batch), x.dtype) for _ in range(4))
        ends, out = end_i + end_j, np.full(batch, INF, x.dtype)
        for k in range(n + m + 1):
            if k <= m:
                now[0] = k * split
            if 0 < k <= n:
                now[k] = k * split
            lo, hi = max(1, k - m), min(n, k - 1)
            if lo <= hi:
                size = hi - lo + 1
                p, q, r, t = moved[:size], divided[:size], merged[:size], some[:size]
                v, w = x[lo - 1 : hi], _opposite(back, lo, hi, k)
                np.abs(np.subtract(v, w, out=p), out=p)
                if x.dtype == np.float64:
                    np.multiply(p, p >= 1e-10, out=p)
                if move != 1.0:
                    np.multiply(p, move, out=p)
                np.add(p, before[lo - 1 : hi], out=p)
                np.abs(np.subtract(w, past_x[lo - 1 : hi], out=q), out=q)
                np.multiply(q, 0.1, out=q)
                np.add(q, np.add(last[lo : hi + 1], split, out=t), out=q)
                np.abs(np.subtract(v, _opposite(back_past, lo, hi, k), out=r), out=r)
                np.multiply(r, 0.1, out=r)
                np.add(r, np.add(last[lo - 1 : hi], split, out=t), out=r)
                np.minimum(np.minimum(p, q, out=p), r, out=now[lo : hi + 1])
            done = np.flatnonzero(ends == k)
            out[done] = now[end_i[done], done]
            before, last, now = last, now, before
        total += out
    return total


@dataclass(frozen=True)
class Measure:
    """A distance of batches, f(a, b, end_i, end_j), for searches.

    slack: for a distance in single precision, its series' largest number and their points together, what the exact one
    can't exceed, and the other way round; none if only double precision counts. coarse: squared costs, which 16 bits can
    bound before. tried: how many pairs those 16 bits met, and how many they left.
    """

    f: Callable
    slack: Callable[[float, float, int], float] | None = None
    batch: int = 1024
    coarse: bool = False
    tried: list[int] = field(default_factory=lambda: [0, 0])


def _dtw_slack(d: float, largest: float, points: int) -> float:
    """A path is at most all points long; each difference may be off by the rounding of both numbers."""
    return (math.sqrt(d) + 2.0**-23 * largest * math.sqrt(points)) ** 2 * (1 + 2.0**-22 * (points + 8)) + 1e-30


def dtw_measure(radius: int | None = None) -> Measure:
    return Measure(lambda a, b, n, m: dtw(a, b, n, m, radius), _dtw_slack, 1024 if radius is None else 2048, radius is None)


def msm_measure(move: float = 1.0, split: float = 1.0) -> Measure:
    """Each of at most as many steps as points adds numbers no larger than ``largest``, the costs and the sum so far."""
    return Measure(lambda a, b, n, m: msm(a, b, n, m, move, split), lambda d, largest, points: d + points * (2.0**-20 * ((1 + move) * largest + split + d) + 1e-9))


def twe(a, b, end_i, end_j, nu=0.001, lam=1.0):
    """Time warp edit distance, the library's variant: edits cost nu and a tenth of the value, matches lam per step of warp."""
    d, n, m, batch = a.shape[0], a.shape[1], b.shape[1], a.shape[2]
    edit_a, edit_b = nu * d + 0.1 * np.abs(a).sum(axis=0), nu * d + 0.1 * np.abs(b).sum(axis=0)
    back, back_edit = b[:, ::-1], edit_b[::-1]

    def cell(lo, hi, k, diagonal, up, left):
        i = np.arange(lo, hi + 1)[:, None]
        match = diagonal + np.abs(a[:, lo - 1 : hi] - _opposite(back, lo, hi, k)).sum(axis=0) + lam * d * np.abs(2 * i - k)
        return np.minimum(np.minimum(match, left + _opposite(back_edit, lo, hi, k)), up + edit_a[lo - 1 : hi])

    edge = lambda e: np.vstack([np.zeros((1, batch)), np.cumsum(e, axis=0)])
    return wavefront(n, m, edge(edit_a), edge(edit_b), cell, end_i, end_j)


def stack(series: list, features: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, time, pairs) with zeros at the end, and the lengths."""
    sizes = np.array([len(s) for s in series])
    out = np.zeros((features or 1, max(1, sizes.max(initial=1)), len(series)))
    for p, s in enumerate(series):
        if len(s):
            out[:, : len(s), p] = np.asarray(s, float)[None] if features is None else np.array([list(v) for v in s], float).T
    return out, sizes


def ncc(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of rows, shifts -(n - 1)..n - 1; zeros where a norm is about zero."""
    n = x.shape[1]
    size = 1 << (2 * n - 1).bit_length()
    product = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
    whole = np.concatenate([product[:, -(n - 1) :], product[:, :n]], axis=1) if n > 1 else product[:, :1]
    norm = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return np.where(norm[:, None] < 1e-9, 0.0, whole / np.where(norm < 1e-9, 1.0, norm)[:, None])


def shifted(y: np.ndarray, shift: int) -> np.ndarray:
    """y moved by ``shift`` places with zeros coming in."""
    out = np.zeros_like(y)
    n = len(y)
    if shift >= 0:
        out[shift:] = y[: n - shift]
    else:
        out[:shift] = y[-shift:]
    return out


def squared(x: np.ndarray) -> np.ndarray:
    """Squares as the C library's ``pow`` gives them, as in SQL: it isn't always x * x, and ties hang on the last bit."""
    if x.size and np.abs(x).max() > 1e150:
        return x * x
    return np.fromiter(map(math.pow, x.ravel().tolist(), repeat(2.0)), float, x.size).reshape(x.shape)


def profiles(x: np.ndarray, m: int, normalize: bool = False, exclusion: int | None = None, constant_infinite: bool = False) -> dict[str, np.ndarray]:
    """As ``matrix_profile``, of series of one length at once (rows of x, rows of the results), lag by lag.

    Squares are added in the order of the points, so equal sums are equal in SQL too.
    """
    zone, size = m // 2 if exclusion is None else exclusion, x.shape[1] - m + 1
    if zone < 1:
        raise ValueError("a window is its own neighbour")
    x = np.ascontiguousarray(np.asarray(x, float).T)
    left, right = np.full((size, x.shape[1]), INF), np.full((size, x.shape[1]), INF)
    left_index, right_index = np.full(left.shape, -1, np.int32), np.full(left.shape, -1, np.int32)
    place = np.arange(size, dtype=np.int32)[:, None]
    flat = None
    if normalize:
        w = np.lib.stride_tricks.sliding_window_view(x, m, axis=0)
        std = w.std(axis=2)
        flat = std < 1e-12
        z = np.ascontiguousarray(((w - w.mean(axis=2)[..., None]) / np.where(flat, 1.0, std)[..., None]).transpose(2, 0, 1))
    for lag in range(zone, size):
        n = size - lag
        odd = None if flat is None else flat[:n] | flat[lag:]
        if flat is None or (odd.any() and not constant_infinite):
            e = squared(x[:-lag] - x[lag:])
            plain = e[:n].copy()
            for t in range(1, m):
                plain += e[t : t + n]
        if flat is None:
            d = plain
        else:
            d = sum((v[:n] - v[lag:]) ** 2 for v in z)
            if odd.any():
                d = np.where(odd, INF if constant_infinite else plain, d)
        d = np.sqrt(d)
        better = d < right[:n]
        np.copyto(right[:n], d, where=better)
        np.copyto(right_index[:n], place[lag:], where=better)
        better = (d <= left[lag:]) & (d < INF)
        np.copyto(left[lag:], d, where=better)
        np.copyto(left_index[lag:], place[:n], where=better)
    first = left <= right
    out = {"distance": np.where(first, left, right), "index": np.where(first, left_index, right_index), "left": left, "left_index": left_index, "right": right, "right_index": right_index}
    return {k: v.T for k, v in out.items()}


def matrix_profile(values: np.ndarray, m: int, normalize: bool = False, exclusion: int | None = None, other: np.ndarray | None = None, constant_infinite: bool = False, rows: tuple[int, int] | None = None, block: int = 256):
    """Distance and first nearest index of each window (with left and right ones), to the series itself or another's.

    Windows nearer than ``exclusion`` (m // 2) places are no neighbours. With ``normalize`` windows are scaled by
    population statistics; a constant window falls back to raw distances, or has none with ``constant_infinite``.
    rows: only the windows from the first number up to the second. Distances of ``block`` windows to all others come
    from one matrix product; those within its error of the least are computed again from the differences.
    """
    a = np.lib.stride_tricks.sliding_window_view(np.asarray(values, float), m)
    b = a if other is None else np.lib.stride_tricks.sliding_window_view(np.asarray(other, float), m)
    zone = m // 2 if exclusion is None else exclusion
    first, last = rows or (0, len(a))
    last = min(last, len(a))

    def scale(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        std = w.std(axis=1)
        flat = std < 1e-12
        return (w - w.mean(axis=1)[:, None]) / np.where(flat, 1.0, std)[:, None], flat

    out = {k: [] for k in ("distance", "index", "left", "left_index", "right", "right_index")}
    zb, fb = scale(b) if normalize else (b, np.zeros(len(b), bool))
    mean = b.mean()
    raw_b, square_b = b - mean, ((b - mean) ** 2).sum(axis=1)
    unit_b = (zb**2).sum(axis=1) if normalize else square_b
    j = np.arange(len(b))
    block = max(1, min(block, (1 << 22) // len(b)))
    for lo in range(first, last, block):
        w = a[lo : min(lo + block, last)]
        i = np.arange(lo, lo + len(w))
        za, fa = scale(w) if normalize else (w, np.zeros(len(w), bool))
        odd = fb | fa[:, None]
        raw = w - mean
        square = (raw**2).sum(axis=1)[:, None] + square_b
        d, size = square - 2 * (raw @ raw_b.T), square
        if normalize:
            unit = (za**2).sum(axis=1)[:, None] + unit_b
            d, size = np.where(odd, INF if constant_infinite else d, unit - 2 * (za @ zb.T)), np.where(odd, size, unit)
        if other is None:
            d = np.where(np.abs(j - i[:, None]) < zone, INF, d)
        slack = 4e-15 * m * size.max(axis=1)
        for name, part in (("", d), ("left", np.where(j < i[:, None], d, INF)), ("right", np.where(j > i[:, None], d, INF))):
            near = part <= (part.min(axis=1) + slack)[:, None]
            near &= np.isfinite(part)
            row, col = np.nonzero(near)
            exact = np.empty(len(row))
            for at in range(0, len(row), 1 << 16):
                r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
                plain = odd[r, c] | (not normalize)
                gap = np.where(plain[:, None], w[r] - b[c], za[r] - zb[c])
                gap = gap**2 if normalize else squared(gap)
                exact[at : at + len(r)] = np.sqrt(sum(gap.T))  # in the order of the points, as in SQL
            order = np.lexsort((col, exact, row))
            best = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
            distance, index = np.full(len(w), INF), np.full(len(w), -1)
            distance[row[best]], index[row[best]] = exact[best], col[best]
            out[name or "distance"].extend(distance.tolist())
            out[f"{name}_index" if name else "index"].extend(index.tolist())
    return out


def top_motifs(distance: np.ndarray, index: np.ndarray, k: int, zone: int) -> list[tuple[int, int, float]]:
    """Repeated least entries, with a zone around both members taken out."""
    left, out = np.where(np.isfinite(distance), distance, INF).copy(), []
    while len(out) < k and np.isfinite(left).any():
        i = int(left.argmin())
        out.append((i, int(index[i]), float(left[i])))
        for c in (i, int(index[i])):
            left[max(0, c - zone) : c + zone + 1] = INF
    return out


def top_discords(distance: np.ndarray, k: int, zone: int) -> list[tuple[int, float]]:
    """Repeated largest finite entries, with a zone around each taken out."""
    left, out = np.where(np.isfinite(distance), distance, -INF).copy(), []
    while len(out) < k and np.isfinite(left).any():
        i = int(left.argmax())
        out.append((i, float(left[i])))
        left[max(0, i - zone) : i + zone + 1] = -INF
    return out
