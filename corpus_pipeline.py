"""A corpus pipeline: five stages over ``documents``, each with the columns of its input but for the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.decontaminate import without_contaminated
from tidewater.llm.near_dedup import near_dedup
from tidewater.llm.scratch import drop, materialize
from tidewater.llm.secrets import find_secrets, redacted
from tidewater.llm.sentencepiece_fst import encode_documents
from tidewater.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    score = "toxic_score"
    while score in {c.lower() for c in docs.columns}:
        score += "_"
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each near-duplicate class, and documents without an id; rows that share id and text stay or go together."""
    gone = near_dedup(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("gone_id"), F.col("print").alias("gone_print")).distinct()
    same = (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_print"))
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti").select([f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark, and ``n_chars``, if there, as it is then."""
    found = find_secrets(docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])), id_col="__row")
    row = {c: F.col("doc_id").getField(c) for c in docs.columns if c != "text"}
    if "n_chars" in row:
        row["n_chars"] = F.when(F.size("spans") > 0, F.length(redacted(F.col("text"), F.col("spans"))).cast("long")).otherwise(row["n_chars"])
    row["text"] = redacted(F.col("text"), F.col("spans"))
    return found.select(*[row[c].alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), cache_segments=120_000)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the scratch space and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            if before is not None:
                drop(before)
            before = docs
    return docs
