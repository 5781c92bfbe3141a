import math

import numpy as np
import pytest

from tidewater.functions import kernels as K


def one(f, a, b, **options):
    x, n = K.stack([a], None)
    y, m = K.stack([b], None)
    return float(f(x, y, n, m, **options)[0])


# The published small series and their distances, which any engine must reproduce.
T1, T3 = [1, 2, 3, 2, 1], [2, 3, 4, 3, 2]


def test_goldens():
    """Fixed values."""
    assert one(K.dtw, T1, T1) == 0
    assert one(K.dtw, T1, T3) == 3 == one(K.dtw, T1, T3, radius=2)
    assert one(K.dtw, [1, 2, 3], [1, 2, 3, 4, 5, 4, 3, 2, 1]) == 11
    assert one(K.dtw, [0] * 5, [10] * 5, threshold=1.0) == np.inf
    near = [1.1, 2.1, 3.1, 2.1, 1.1]
    assert one(K.lcss, T1, near, epsilon=0.2, delta=1) == 5
    assert one(K.msm, T1, near) == pytest.approx(0.5) and one(K.msm, T1, [1, 3, 2]) == pytest.approx(2.3)
    assert one(K.twe, T1, near) == pytest.approx(0.5) and one(K.twe, T1, [1, 3, 2]) == pytest.approx(1.306)


def plain_dtw(a, b, radius=None):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if radius is None or abs(i - j) <= radius:
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[-1, -1]


def test_dtw_batches_of_unequal_lengths_match_a_plain_program():
    rng = np.random.default_rng(1)
    a, b = ([rng.normal(size=rng.integers(1, 9)) for _ in range(40)] for _ in range(2))
    x, n = K.stack(a, None)
    y, m = K.stack(b, None)
    for radius in (None, 2):
        assert np.allclose(K.dtw(x, y, n, m, radius), [plain_dtw(p, q, radius) for p, q in zip(a, b, strict=True)])
    cost, paths = K.dtw_paths(x, y, n, m)
    for p, q, c, path in zip(a, b, cost, paths, strict=True):
        assert path[0] == (0, 0) and path[-1] == (len(p) - 1, len(q) - 1)
        assert c == pytest.approx(sum((p[i] - q[j]) ** 2 for i, j in path))


def test_ncc_matches_the_definition():
    # A published pair of series.
    x, y = np.array([[1, 2, 3, 2, 1, 0, 1, 2.0]]), np.array([[0.5, 1.5, 2.5, 1.5, 0.5, -0.5, 0.5, 1.5]])
    n = 8
    want = [sum(x[0, i] * y[0, i - s] for i in range(n) if 0 <= i - s < n) / np.linalg.norm(x) / np.linalg.norm(y) for s in range(-n + 1, n)]
    assert np.allclose(K.ncc(x, y)[0], want)


def plain_profile(v, m, normalize, zone, other=None):
    w = np.lib.stride_tricks.sliding_window_view(np.asarray(v, float), m)
    x = w if other is None else np.lib.stride_tricks.sliding_window_view(np.asarray(other, float), m)
    scale = lambda u: (u - u.mean()) / u.std() if u.std() >= 1e-12 else u
    out = []
    for i, p in enumerate(w):
        d = [np.linalg.norm(scale(p) - scale(q)) if normalize and min(p.std(), q.std()) >= 1e-12 else np.linalg.norm(p - q) for q in x]
        near = [(dist, j) for j, dist in enumerate(d) if other is not None or abs(i - j) >= zone]
        out.append(min(near) if near else (np.inf, -1))
    return out


@pytest.mark.parametrize("normalize", [False, True])
def test_matrix_profile_matches_a_plain_program(normalize):
    """Also with repeated windows, where the first of equals counts, constant stretches, rows by blocks, and two series."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(0, 4, 60).astype(float), np.full(15, 2.0), rng.normal(50, 9, 40), np.full(12, 7.0)])
    u = np.concatenate([v[20:50], rng.normal(0, 1, 30)])
    for block in (256, 7):
        p = K.matrix_profile(v, 6, normalize, block=block)
        want = plain_profile(v, 6, normalize, 3)
        assert np.allclose(p["distance"], [d for d, _ in want], atol=1e-9)
        assert normalize or p["index"] == [j for _, j in want]  # scaled windows tie up to rounding
    part = K.matrix_profile(v, 6, normalize, rows=(30, 71))
    assert part["index"] == p["index"][30:71] and len(K.matrix_profile(v, 6, rows=(120, 400))["index"]) == 2
    left, right = np.array(p["left"]), np.array(p["right"])
    assert np.array_equal(np.minimum(left, right), p["distance"]) and all(j < i for i, j in enumerate(p["left_index"]))
    both = K.matrix_profile(v, 6, normalize, other=u)
    assert np.allclose(both["distance"], [d for d, _ in plain_profile(v, 6, normalize, 0, u)], atol=1e-9)
    scaled = K.matrix_profile(10 * v + 100, 6, normalize=True)
    assert np.allclose(scaled["distance"][:50], K.matrix_profile(v, 6, normalize=True)["distance"][:50], atol=1e-7)


def test_picks():
    d = np.array([3.0, 1, 2, 0.5, 9, np.inf])
    assert [i for i, _ in K.top_discords(d, 2, 0)] == [4, 0]
    assert K.top_motifs(d, np.array([3, 3, 3, 0, 0, 0]), 1, 1) == [(3, 0, 0.5)]


def test_profile_distances_are_sums_in_order():
    """Bit for bit as SQL adds them, by ``pow`` and point by point, so windows tie here where they tie there."""
    rng = np.random.default_rng(11)
    x = np.round(rng.exponential(50, (30, 40)), 2)
    want = []
    for v in x.tolist():
        row = []
        for i in range(33):
            near = []
            for j in (j for j in range(33) if abs(i - j) >= 4):
                total = 0.0
                for t in range(8):
                    total += math.pow(v[i + t] - v[j + t], 2)
                near.append((math.sqrt(total), j))
            row.append(min(near))
        want.append(row)
    p = K.profiles(x, 8)
    assert [list(zip(d, j, strict=True)) for d, j in zip(p["distance"].tolist(), p["index"].tolist(), strict=True)] == want
    for v, row in zip(x, want, strict=True):
        p = K.matrix_profile(v, 8)
        assert list(zip(p["distance"], p["index"], strict=True)) == row


@pytest.mark.parametrize("normalize", [False, True])
def test_profiles_of_many_series_equal_those_of_each(normalize):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (20, 50))
    x[3, 10:30], x[4], x[5] = 2.0, 1.0, rng.integers(0, 3, 50)
    for infinite in (False, True):
        many = K.profiles(x, 6, normalize, None, infinite)
        for row, v in enumerate(x):
            one = K.matrix_profile(v, 6, normalize, None, None, infinite)
            for k in one:
                assert np.allclose(many[k][row], one[k], atol=1e-12), k


@pytest.mark.parametrize("scale", [0.1, 1.0, 300.0])
def test_16_bits_never_rule_out_a_near_series(scale):
    """Of noise, walks and copies, where sums in 16 bits start again from 0 too; and most of what is far goes."""
    from tidewater.operators import search as S

    rng = np.random.default_rng(14)
    noise = rng.normal(0, scale, (600, 40))
    x = np.concatenate([noise, np.cumsum(rng.normal(0, scale, (600, 40)), axis=1), noise[:50]])
    rows, every = S.Rows(x), np.arange(len(x))
    for query in (x[0], x[700], rng.normal(0, scale, 40)):
        d = S.exact(K.dtw_measure(), [query], rows, [every])[0]
        for limit in np.quantile(d[d > 0], [0.0, 0.01, 0.3, 1.0]):
            measure = K.dtw_measure()
            left = rows.within(query, measure, every, limit)
            assert measure.tried[0] == len(x) and set(np.flatnonzero(d <= limit)) <= set(left)
    rough = rows.rough(x[0], measure, every, 100.0).astype(float)
    big = S.exact(K.dtw_measure(), [np.rint(x[0] * 100.0)], S.Rows(np.rint(x * 100.0)), [every])[0]
    assert (rough <= big).all() and (big.max() < 65536 or (rough < big).any())
    measure = K.dtw_measure()
    d = S.exact(measure, [x[0]], rows, [every[:600]])[0]
    assert len(rows.within(x[0], measure, every[:600], np.sort(d)[5])) < 120
