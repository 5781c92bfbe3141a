"""The queries of this subpackage over the corpus tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _modulo(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), _modulo(5) != 0)
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(_modulo(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, find_secrets

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op4_sentencepiece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_fst import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .binary_output import read_dataset, write_dataset

    return read_dataset(spark, write_dataset(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_score

    return lm_score(_table(spark, sf_dir, "documents"), _modulo(7) == 2)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_secret_scans, op4_sentencepiece_transducer, op5_minhash_near_dedup, op6_html_extraction, op7_benchmark_decontamination, op8_binary_output, op9_lm_scoring, op10_topk_search)}


_OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT win, min(doc_id) AS first FROM s GROUP BY win),
c AS (SELECT s.doc_id, list(s.p) AS ps FROM s JOIN f USING (win) WHERE f.first < s.doc_id GROUP BY s.doc_id),
x AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM (SELECT doc_id, unnest(ps) AS p FROM c))),
r AS (SELECT doc_id, list(q) AS gone FROM x GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, w, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id)),
e AS (SELECT doc_id, n, len(gone) AS g, CASE WHEN len(gone) = 0 THEN w ELSE list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE w[i] END), lambda v: v IS NOT NULL) END AS kept FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM e
"""

_OP5 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, g, count(*) AS c FROM (SELECT r, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d WHERE doc_id IS NOT NULL AND len(w) > 0) GROUP BY r, g),
n AS (SELECT r, sum(c) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, sum(least(a.c, b.c)) AS s FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE s >= CAST(0.8 AS DOUBLE) * (x.n + y.n - s)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r AS a, r AS b FROM n UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
k AS (SELECT c.a AS r, min(d.doc_id) AS class_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id FROM d LEFT JOIN k ON k.r = d.r
"""

_OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op5_minhash_near_dedup": _OP5, "op10_topk_search": _OP10}
