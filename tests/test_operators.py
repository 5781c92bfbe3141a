from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import exprs as X
from tidewater.functions import kernels as K
from tidewater.functions import udfs as U
from tidewater.operators import classify as C
from tidewater.operators import clustering as G
from tidewater.operators import search as S
from tidewater.operators import shapelets as H
from tidewater.sources.series import check_dimensions, check_equal_length, collect_series, from_column, to_column


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.cumsum(rng.normal(0, 0.1, 16)).tolist(), i % 3) for i in range(60)]
    return spark.createDataFrame(rows, "series_id long, values array<double>, label int").cache()


def test_pruned_search_equals_brute_force(series):
    queries = series.where("series_id % 7 = 0")
    for radius in (None, 3):
        want = S.knn(queries, series, 4, radius).collect()
        assert sorted(S.knn_pruned(queries, series, 4, radius).collect()) == sorted(want)
    few = S.top(S.pairs(queries, series, broadcast_bytes=400).select("query_id", "series_id", U.dtw("query", "values").alias("distance")), 4)
    assert sorted(few.collect()) == sorted(S.knn(queries, series, 4).collect())


def test_pruned_search_of_unequal_lengths_prunes(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (np.cumsum(rng.normal(0, 1, rng.integers(1, 30))) + rng.normal(0, 20)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "series_id long, values array<double>")
    queries = df.where("series_id % 40 = 0")
    for radius in (None, 4):
        want = [(r["query_id"], r["rank"], r["series_id"], round(r["distance"], 9)) for r in S.knn(queries, df, 3, radius).collect()]
        for limit in (32_000_000, 100):
            got = [(r["query_id"], r["rank"], r["series_id"], round(r["distance"], 9)) for r in S.knn_pruned(queries, df, 3, radius, limit).collect()]
            assert sorted(got) == sorted(want)
    by_length, computed = {}, 0
    for i, v in rows:
        by_length.setdefault(len(v), []).append((i, v))
    near = S.Nearest(np.array(rows[0][1]), 3, None)
    for part in by_length.values():
        x = np.array([v for _, v in part])
        near.see(np.array([i for i, _ in part]), x, near.bounds(x, None, None))
    assert near.computed < 200
    with pytest.raises(ValueError):
        S.knn_pruned(queries, df, 0)


def test_neighbours_by_a_custom_metric(spark, series):
    queries = series.where("series_id % 20 = 0")
    own = U.custom(lambda x, y, n, m: np.abs(x - y).sum(axis=(0, 1)))
    got = {(r["query_id"], r["rank"]): r["series_id"] for r in S.knn(queries, series, 2, metric=own).collect()}
    rows = {r["series_id"]: np.array(r["values"]) for r in series.collect()}
    for q in (0, 20, 40):
        want = sorted(rows, key=lambda i: (np.abs(rows[i] - rows[q]).sum(), i))[:2]
        assert [got[q, 1], got[q, 2]] == want


def test_self_pairs_by_group(series):
    got = {(r["label"], r["id_a"], r["id_b"]) for r in S.self_pairs(series, block=7, by="label").collect()}
    assert got == {(a % 3, a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3}


def test_self_pairs_give_each_pair_once(series):
    got = [(r["id_a"], r["id_b"]) for r in S.self_pairs(series, block=7).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2


def test_bounds_hold(series):
    p = S.self_pairs(series).select(U.dtw("a", "b", radius=3).alias("d"), X.lb_improved(F.col("a"), F.col("b"), 3).alias("k"), X.lb_yi(F.col("a"), F.col("b")).alias("y"))
    assert p.where("k * k > d + 1e-9 or y * y > d + 1e-9").count() == 0


def test_kmeans_and_kshape(spark):
    rows = [(i, [v + 0.1 * i + 0.01 * t for t in range(5)]) for i, v in enumerate((1.0, 1.0, 5.0, 5.0, 10.0, 10.0))]
    df = spark.createDataFrame(rows, "series_id long, values array<double>")
    for metric in ("euclidean", "dtw"):
        model = G.KMeans(k=3, metric=metric, max_iter=5, barycenter_iter=1, init=[rows[i][1] for i in (0, 2, 4)]).fit(df)
        c = [r["cluster"] for r in model.predict(df).orderBy("series_id").collect()]
        assert c == [0, 0, 1, 1, 2, 2]
    assert len(G.KShape(k=2, max_iter=2).fit(df).centres) == 2
    with pytest.raises(ValueError):
        G.KMeans(k=0).fit(df)


def test_clusterings_draw_their_starts_and_report_lost_clusters(spark, series):
    """Starts by chance don't depend on the partitions; the best of several runs stays; a cluster without members is an error."""
    for init in ("random", "k-means++"):
        one, two = (G.KMeans(k=3, init=init, max_iter=4, seed=5).fit(df) for df in (series, series.repartition(7)))
        assert np.allclose(one.centres, two.centres) and one.inertia == pytest.approx(two.inertia)
        several = G.KMeans(k=3, init=init, max_iter=4, seed=5, n_init=3).fit(series)
        assert several.inertia <= one.inertia + 1e-9
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(4)]
    same = spark.createDataFrame(rows, "series_id long, values array<double>")
    with pytest.raises(G.EmptyClusterError):
        G.KMeans(k=2, init=[[1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]).fit(same)
    with pytest.raises(G.EmptyClusterError):
        G.KShape(k=2, init=[[1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]).fit(same)
    with pytest.raises(ValueError):
        G.KMeans(init="other").fit(series)
    plain, by_dtw = (G.KMeans(k=2, init="random", max_iter=3, dtw_inertia=x).fit(series) for x in (False, True))
    near = by_dtw.predict(series).collect()
    cost = sum(plain_dtw(r["values"], by_dtw.centres[r["cluster"]]) for r in near)
    assert by_dtw.inertia == pytest.approx(cost) and plain.inertia != by_dtw.inertia


def plain_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = (x - y) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[-1, -1]


def test_shape_extraction_matches_a_plain_program(series):
    """The top eigenvector of the centred Gram matrix of members shifted to the centre, with the sign nearer to them."""
    rows = [np.array(r["values"]) for r in series.orderBy("series_id").collect()]
    centre, n = rows[0], 16

    def moved(v):
        best = max(range(-n + 1, n), key=lambda s: (round(sum(centre[i] * v[i - s] for i in range(n) if 0 <= i - s < n), 12), -s))
        return np.array([v[i - best] if 0 <= i - best < n else 0.0 for i in range(n)])

    x = np.stack([moved(v) for v in rows])
    q = np.eye(n) - 1.0 / n
    mu = np.linalg.eigh(q @ x.T @ x @ q)[1][:, -1]
    mu = min(mu, -mu, key=lambda m: np.linalg.norm(x - m, axis=1).sum())
    assert np.allclose(G.shape_extraction(series, centre.tolist()), mu, atol=1e-8)


def test_kshape_runs_improve_and_agree_with_their_assignment(series):
    model = G.KShape(k=3, max_iter=5, n_init=2).fit(series)
    again = G.KShape(k=3, max_iter=5, n_init=2).fit(series.repartition(5))
    assert np.allclose(model.centres, again.centres)
    first = G.assign(series, G.KMeans(3, init="random").start(series, 0), "sbd").agg(F.sum("distance")).first()[0]
    assert model.inertia <= first + 1e-9
    assert model.predict(series).agg(F.sum("distance")).first()[0] == pytest.approx(model.inertia)


def test_barycenter_stops_by_shape(series):
    by_cost, by_shape = (G.dba_barycenter(series, max_iter=30, tol=1e-4, stop=s) for s in ("cost", "shape"))
    assert by_cost[1] == pytest.approx(by_shape[1], abs=0.01)
    with pytest.raises(ValueError):
        G.dba_barycenter(series, stop="never")


def test_shapelets_are_checked_and_told_apart(spark):
    rows = [("a", 1, 0, None, [1.0, 2.0]), ("b", 1, 0, "x", [1.0, 2.0]), ("c", 1, 1, "x", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "candidate_id string, source long, start int, label string, values array<double>")
    assert [r["candidate_id"] for r in H.distinct(df).orderBy("candidate_id").collect()] == ["a", "c"]
    assert {r["label"] for r in H.checked(df).collect()} == {"unknown", "x"}
    for bad in ([], [1.0, None], [float("nan")], [float("inf")], None):
        one = spark.createDataFrame([("a", bad)], "candidate_id string, values array<double>")
        with pytest.raises(Exception, match="finite numbers"):
            H.checked(one).collect()


def test_shapelet_distances_by_arrays_equal_those_by_expressions(spark, series):
    shapes = spark.createDataFrame([("s", [0.1, 0.2, 0.1]), ("t", [0.0] * 5), ("long", [0.0] * 17)], "candidate_id string, values array<double>")
    one, two = ({(r["series_id"], r["candidate_id"]): (round(r["distance"], 9), r["position"]) if r["distance"] is not None else None for r in H.distances(series, shapes, limit).collect()} for limit in (10**9, 1))
    assert one == two and len(one) == 180 and all((v is None) == (k[1] == "long") for k, v in one.items())


def test_shapelet_qualities_match_plain_programs(spark):
    rng = np.random.default_rng(1)
    rows = [(c, str(rng.integers(0, 3)), float(np.round(rng.normal(), 1))) for c in ("a", "b") for _ in range(60)] + [("one", "x", 1.0), *(("same", x, 2.0) for x in "xxyy"), ("none", "x", None)]
    found = spark.createDataFrame(rows, "candidate_id string, label string, distance double")

    def entropy(labels):
        return -sum(p * np.log2(p) for p in (labels.count(x) / len(labels) for x in set(labels)))

    def gain(part):
        part = sorted(part, key=lambda r: r[2])
        cuts = [(a[2] + b[2]) / 2 for a, b in zip(part, part[1:], strict=False)]
        gains = []
        for cut in cuts:
            left, right = [r[1] for r in part if r[2] <= cut], [r[1] for r in part if r[2] > cut]
            gains.append(entropy([r[1] for r in part]) - sum(len(s) / len(part) * entropy(s) for s in (left, right)) if left and right else 0.0)
        return max(gains, default=-np.inf)

    got = {r["candidate_id"]: r["quality"] for r in H.quality(found).collect()}
    want = {c: gain([r for r in rows if r[0] == c]) for c in ("a", "b", "one", "same")}
    assert got == pytest.approx(want)
    ranges = {r["candidate_id"]: r["quality"] for r in H.quality(found, "median_range").collect()}
    upper = lambda c, x: sorted(r[2] for r in rows if r[:2] == (c, x))
    for c in ("a", "b"):
        middles = [v[len(v) // 2] for x in "012" if (v := upper(c, x))]
        assert ranges[c] == pytest.approx(max(middles) - min(middles))
    with pytest.raises(ValueError):
        H.quality(found, "other")


def test_shapelet_candidates_by_kmeans(series):
    got = H.kmeans_candidates(series, [3, 5, 40], 6, max_iter=3).collect()
    assert {len(r["values"]) for r in got} == {3, 5} and len(got) == 4 and {r["label"] for r in got} == {"centroid"}
    for init in ("random", "balanced", "kmeans"):
        assert len(H.fit(series.withColumn("label", F.col("label").cast("string")), [4], n=3, limit=8, init=init)) >= 1
    with pytest.raises(ValueError):
        H.fit(series, [4], init="other")


def patterned(spark, n, t=24, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v, up = rng.normal(0, 0.1, t), i % 2
        v[6:11] += np.array([1, 2, 3, 2, 1]) * (1 if up else -1)
        rows.append((i, v.tolist(), "up" if up else "down"))
    return spark.createDataFrame(rows, "series_id long, values array<double>, label string")


def test_classifiers_and_the_early_ensemble(spark):
    train, test = patterned(spark, 24), patterned(spark, 10, seed=1).withColumn("series_id", F.col("series_id") + 100)
    truth = {r["series_id"]: r["label"] for r in test.collect()}
    members = [C.NearestNeighbours(k=3), C.FeatureClassifier(), C.ShapeletClassifier(limit=60)]
    for m in members:
        fitted = m.fit(train)
        p = fitted.predict_proba(test.select("series_id", "values"))
        sums = [r[0] for r in p.groupBy("series_id").agg(F.sum("p")).select("sum(p)").collect()]
        assert len(sums) == 10 and sums == pytest.approx([1.0] * 10)
        assert sum(truth[r["series_id"]] == r["predicted"] for r in C.predict(p).collect()) >= 9, m.name

    class Broken:
        name = "broken"

        def fit(self, train):
            raise ValueError("no")

    brief = spark.createDataFrame([(500, [1.0, 2.0], "up")], "series_id long, values array<double>, label string")
    ensemble = C.EarlyClassifier([*members, Broken()], threshold=0.5, shortest=8, step=4).fit(train)
    assert [m.name for m in ensemble.members] == ["neighbours", "feature", "shapelet"]
    for how in ("average", "majority", "weighted", "max"):
        model = replace(ensemble, aggregation=how)
        rows = {r["series_id"]: r for r in model.predict(test.unionByName(brief)).collect()}
        assert len(rows) == 11 and (rows[500]["predicted"], rows[500]["confidence"], rows[500]["stopped"], rows[500]["earliness"]) == ("down", 0.0, 8, -3.0)
        if how == "average":
            result = C.evaluate(model.predict(test), test).first()
            assert result["accuracy"] >= 0.8 and 0 < result["earliness"] < 1
    with pytest.raises(ValueError):
        C.EarlyClassifier([Broken()]).fit(train)
    for bad in ({"threshold": 0.0}, {"margin": 2.0}, {"shortest": 0}, {"step": 0}, {"rule": "x"}, {"aggregation": "x"}):
        with pytest.raises(ValueError):
            C.EarlyClassifier(members, **bad)


def test_a_prefix_below_a_shapelet_has_equal_probabilities(spark):
    train = patterned(spark, 8)
    shapes = spark.createDataFrame([("a", [0.0] * 6)], "candidate_id string, values array<double>")
    model = C.ShapeletClassifier(shapelets=shapes).fit(train)
    assert {r["p"] for r in model.predict_proba(spark.createDataFrame([(1, [1.0, 2.0])], "series_id long, values array<double>")).collect()} == {0.5}


def test_early_stream_equals_its_twin(spark, tmp_path):
    from tidewater.streaming.early import classify_early, confidence, mean_model

    train, test = patterned(spark, 12), patterned(spark, 6, seed=3)
    model = mean_model(train)
    points = test.select("series_id", F.posexplode("values").alias("t", "x"))
    points.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    q = classify_early(stream, model, 6, 2, 0.2, "series_id", "x", "t").writeStream.format("memory").queryName("early").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["series_id"]: (r["t"], r["label"], round(r["confidence"], 9)) for r in spark.table("early").collect()}
    want = {}
    for r in test.collect():
        for t in range(6, 25, 2):
            p = model(np.array(r["values"][:t]))
            if confidence(p) >= 0.2:
                want[r["series_id"]] = (t, max(sorted(p), key=p.get), round(confidence(p), 9))
                break
    assert got == want and got


def test_self_matrix_and_paths_match_plain_programs(spark, series):
    rows = {r["series_id"]: r["values"] for r in series.collect()}
    got = S.self_pairs(series).where("id_b < 12").select("id_a", "id_b", U.dtw("a", "b").alias("d")).collect()
    assert len(got) == 66 and all(r["d"] == pytest.approx(plain_dtw(rows[r["id_a"]], rows[r["id_b"]])) for r in got)


def test_sources_check_their_input(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 0, 1.0), (2, 0, 3.0)], "id long, t int, v double")
    got = collect_series(df, "id", "v", "t")
    assert sorted((r[0], r[1]) for r in got.collect()) == [(1, [1.0, 2.0]), (2, [3.0])]
    with pytest.raises(ValueError):
        check_equal_length(got)
    points = spark.createDataFrame([([[1.0], [2.0]],)], "values array<array<double>>")
    assert check_dimensions(points) == 1 and points.select(from_column(F.col("values"))).first()[0] == [1.0, 2.0]
    assert points.select(to_column(from_column(F.col("values")))).first()[0] == [[1.0], [2.0]]
    ragged = spark.createDataFrame([([[1.0], [2.0, 3.0]],)], "values array<array<double>>")
    with pytest.raises(ValueError):
        check_dimensions(ragged)
    with pytest.raises(Exception, match="one feature"):
        ragged.select(from_column(F.col("values"))).collect()


def test_lcss_of_empty_series(spark):
    df = spark.createDataFrame([([], []), ([1.0], []), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(U.lcss("a", "b")).collect()] == [0.0, 1.0, None]


def test_udfs_in_sql(spark):
    U.register(spark)
    row = spark.sql("""select dtw(a, b) as dtw, dtw_sakoe_chiba(a, b, 1) as band, lcss(a, b) as lcss, msm(a, b) as msm, twe(a, b) as twe, sbd(a, a) as sbd, best_shift(a, a) as shift,
        dtw_multivariate(array(a, b), array(a, a)) as several, lcss(array(), array()) as none, dtw(null, b) as missing from (select array(1D, 2D, 3D) as a, array(1D, 2D, 4D) as b)""").first()
    assert (row["dtw"], row["band"], row["shift"], row["none"], row["several"], row["missing"]) == (1.0, 1.0, 0.0, 0.0, 1.0, None)
    assert row["lcss"] == pytest.approx(1 / 3) and row["sbd"] == pytest.approx(0)


def test_streaming_detector_equals_its_twin(spark, tmp_path):
    from tidewater.operators.profile import streaming_twin
    from tidewater.streaming.discords import detect_discords

    rng = np.random.default_rng(0)
    rows = [(k, t, float(np.sin(t) + rng.normal(0, 0.1) + (5 if t == 35 else 0))) for k in (1, 2) for t in range(45)]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = detect_discords(stream, 16, 8, 3.0, "k", "v", "t")
    q = out.writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["k"], r["t"]): r["flag"] for r in spark.table("found").collect()}
    want = {(r["k"], r["t"]): r["flag"] for r in streaming_twin(df, 16, 8, 3.0, "k", "v", "t").collect()}
    assert got == want and any(got.values())


@pytest.mark.parametrize("shift", [0.0, 1e5, 1e16])
def test_searches_on_arrays_equal_those_on_all_pairs(spark, shift):
    """Also with copies, unequal lengths, and numbers whose differences single precision loses or can't hold."""
    rng = np.random.default_rng(12)
    rows = [(i, (shift + rng.normal(0, 1, int(rng.integers(3, 9)))).tolist(), i % 4) for i in range(70)]
    rows += [(i, rows[i - 70][1], i % 4) for i in range(70, 90)]
    df = spark.createDataFrame(rows, "series_id long, values array<double>, label int").repartition(3).cache()
    asked = df.where("series_id % 5 = 0")
    for radius in (None, 2):
        all_pairs = S.pairs(asked, df).select("query_id", "series_id", U.dtw("query", "values", radius).alias("distance")).cache()
        assert sorted(S.knn(asked, df, 3, radius).collect()) == sorted(S.top(all_pairs, 3).collect())
        assert sorted(S.knn_pruned(asked, df, 3, radius).collect()) == sorted(S.top(all_pairs, 3).collect())
        assert sorted(S.knn(asked, df, 1, radius, others=True).collect()) == sorted(S.top(all_pairs.where("query_id <> series_id"), 1).collect())
        assert sorted(S.within(asked, df, 2.0, radius).collect()) == sorted(all_pairs.where("distance <= 2.0").collect())
        for limit in (32_000_000, 300):
            assert sorted(S.crossed(asked, df, S.measured(K.dtw_measure(radius)), broadcast_bytes=limit).collect()) == sorted(all_pairs.collect())
    every = S.self_pairs(df).select("id_a", "id_b", U.dtw("a", "b").alias("distance"))
    assert sorted(S.self_distances(df).collect()) == sorted(every.collect())
    paths = S.pairs(asked, df).select("query_id", "series_id", U.dtw_path("query", "values").alias("d")).selectExpr("query_id", "series_id", "d.distance", "size(d.path) AS steps")
    assert sorted(S.crossed(asked, df, S.steps, "distance double, steps int").collect()) == sorted(paths.collect())


def test_nearest_others_of_every_series(spark):
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(0, 1, 8).tolist(), i % 3) for i in range(230)] + [(i, [float(i % 5)] * 8, i % 3) for i in range(230, 260)]
    df = spark.createDataFrame(rows, "series_id long, values array<double>, label int").cache()
    d = S.pairs(df, df).where("query_id <> series_id").select(F.col("query_id").alias("series_id"), F.col("series_id").alias("train_id"), U.dtw("query", "values", 2).alias("distance"))
    want = C.nearest_probabilities(d.join(df.select(F.col("series_id").alias("train_id"), "label"), "train_id"), 3)
    got = C.nearest_probabilities(S.self_nearest(df, 3, 2), 3)
    plain = lambda x: sorted((r["series_id"], r["label"], round(r["p"], 9)) for r in x.collect())
    assert plain(got) == plain(want)
    mean = S.self_pairs(df, by="label").groupBy("label").agg(F.avg(U.dtw("a", "b", 2)).alias("mean"), F.count("*").alias("pairs"))
    near = lambda x: sorted((r["label"], round(r["mean"], 9), r["pairs"]) for r in x.collect())
    assert near(S.self_mean(df, "label", 2)) == near(mean)


def test_array_neighbours_equal_those_of_all_pairs(spark):
    train, test = patterned(spark, 60), C.prefixes(patterned(spark, 12, seed=4), 6, 6).select(F.struct("series_id", "t").alias("series_id"), "values")
    for metric in (None, U.msm):
        model = C.NearestNeighbours(k=3, metric=metric).fit(train)
        got, want = model.predict_proba(test), C.nearest_probabilities(model.distances(test), 3)
        plain = lambda x: sorted((tuple(r["series_id"]), r["label"], round(r["p"], 9)) for r in x.collect())
        assert plain(got) == plain(want) and got.count()


def test_queries_classify_every_series(spark):
    from tidewater.plans.queries import QUERIES

    for name in ("dtw_1nn", "early_dtw_knn"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").select("series_id").distinct().count() == 500


def test_a_barycenter_step_averages_along_paths_in_bounded_memory(spark, series):
    import tracemalloc

    centres = G.euclidean_barycenter(series, "label")
    near = series.join(centres.withColumnRenamed("values", "centre"), "label").select("label", U.dtw_path("centre", "values").alias("d"), "values")
    points = near.select("label", F.explode("d.path").alias("s"), "values").groupBy("label", "s.i").agg(F.avg(F.get("values", F.col("s.j"))).alias("x"))
    want = {(r["label"], r["i"]): r["x"] for r in points.collect()}
    cost = {r["label"]: r["c"] for r in near.groupBy("label").agg(F.avg("d.distance").alias("c")).collect()}
    got = G.dba_step(series, centres, "label").collect()
    assert {(r["label"], i): pytest.approx(x) for r in got for i, x in enumerate(r["values"])} == want
    assert {r["label"]: pytest.approx(r["cost"]) for r in got} == cost
    x = np.random.default_rng(0).normal(0, 1, (10_000, 40))
    tracemalloc.start()
    sums = G._paths_sums(x[0], x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000 and sums[1, -1] == len(x) and (sums[1, :-1] >= len(x)).all()


def test_distances_to_centres_keep_nulls_and_lengths(spark):
    rows = [(0, [1.0, 2.0, 4.0]), (1, None), (2, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "series_id long, values array<double>")
    centres = [[1.0, 2.0, 3.0], [4.0, 1.0, 1.0]]
    got = {r["series_id"]: r["distances"] for r in G.transform(df, centres, "dtw").collect()}
    assert got == {i: [None if v is None else pytest.approx(plain_dtw(v, c)) for c in centres] for i, v in rows}
