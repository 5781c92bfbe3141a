"""Shared scratch space: cutting lineage with written tables, and fixed-size bitmaps as runtime filters."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a temporary folder of this process, which only a local master can share; it goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidewater-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{scratch_root(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "stage", batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, so that lost executors cost no recomputation.

    batch_rows: most rows of an Arrow batch on the way, for rows that are large.
    """
    spark = df.sparkSession
    path = new_path(spark, kind)
    before = spark.conf.get(_BATCH)
    if batch_rows:
        spark.conf.set(_BATCH, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def positional(df: DataFrame) -> DataFrame:
    """``df`` with the column names c0, c1, ...: Arrow functions can't read a column whose name holds a dot."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def bitmap(df: DataFrame, key: Column, bits: int) -> np.ndarray:
    """Bitmap of the top ``bits`` bits of the well-mixed long ``key``: 2**bits / 8 bytes whatever the input holds.

    It serves as a runtime filter with one-sided error: a set bit means "perhaps", a clear one "no". The words are
    OR-ed on the executors; the driver gets at most 2**(bits - 6) of them.
    """
    cells = (
        df.select(F.shiftrightunsigned(key, 64 - bits).alias("p"))
        .select(F.expr("cast(shiftrightunsigned(p, 6) as int)").alias("at"), F.expr("shiftleft(1L, cast(p & 63L as int))").alias("word"))
        .groupBy("at")
        .agg(F.bit_or("word").alias("word"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells["at"].to_numpy()] = cells["word"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 ``keys`` have their bit set."""
    p = keys >> np.uint64(64 - 6 - (len(words).bit_length() - 1))
    return (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0
