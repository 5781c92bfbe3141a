import math
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tidewater.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")

    def rows(names, records):
        return sorted(tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in (r[n] for n in names)) for r in records)

    for name in ("series_collect", "scale_mean_variance", "dtw", "msm", "twe", "lb_improved", "euclidean_barycenter", "matrix_profile", "series_features", "dtw_path", "kmeans_euclidean", "discords", "shapelet_fit", "early_predict"):
        got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
        cur = con.execute(SQL[name])
        cols = [c[0] for c in cur.description]
        want = [dict(zip(cols, r, strict=True)) for r in cur.fetchall()]
        assert rows(sorted(cols), got) == rows(sorted(cols), want), name


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
