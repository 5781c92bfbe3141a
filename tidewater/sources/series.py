"""Series from tables: observations to one row per series and back, and checks of their shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collect_series(df: DataFrame, id_col: str, value_col: str, *order: str) -> DataFrame:
    """(series_id, values): the values of each id in order; a null value is an error."""
    part = F.array_sort(F.collect_list(F.struct(*order, F.col(value_col).cast("double").alias("value"))))
    checked = F.when(F.col(value_col).isNull(), F.raise_error(F.lit("a series must not hold nulls"))).otherwise(F.col(value_col))
    rows = df.select(F.col(id_col).cast("long").alias("series_id"), *order, checked.alias(value_col))
    return rows.groupBy("series_id").agg(part.alias("p")).select("series_id", F.transform("p", lambda x: x["value"]).alias("values"))


def explode_series(df: DataFrame) -> DataFrame:
    """(series_id, t, value), t from 0."""
    return df.select("series_id", F.posexplode("values").alias("t", "value"))


def flatten(v: Column) -> Column:
    return F.flatten(v)


def unflatten(v: Column, rows: int, columns: int) -> Column:
    """Row-major parts; an array of another size is an error."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(v, i * columns + 1, columns))
    return F.when(F.size(v) == rows * columns, parts).otherwise(F.raise_error(F.lit("size does not match")).cast("array<array<double>>"))


def to_column(v: Column) -> Column:
    """A univariate series as one of points with one feature."""
    return F.transform(v, lambda x: F.array(x))


def from_column(v: Column) -> Column:
    """The inverse of ``to_column``; points with another number of features are an error."""
    one = F.forall(v, lambda p: F.size(p) == 1)
    return F.when(one, F.transform(v, lambda p: F.get(p, F.lit(0)))).otherwise(F.raise_error(F.lit("points must have one feature")).cast("array<double>"))


def check_dimensions(df: DataFrame, column: str = "values") -> int:
    """The one number of features of all points of array<array> series; an error if there are several."""
    low, high = df.select(F.explode(F.col(column)).alias("p")).agg(F.min(F.coalesce(F.size("p"), F.lit(0))), F.max(F.size("p"))).first()
    if low is None or low < 1 or low != high:
        raise ValueError("all points must have one number of features of at least 1")
    return low


def check_equal_length(df: DataFrame, column: str = "values") -> int:
    """The one length of all series; an error if there are several, or a series is null or empty."""
    low, high, bad = df.agg(F.min(F.size(column)), F.max(F.size(column)), F.count_if(F.col(column).isNull())).first()
    if bad or low is None or low < 1 or low != high:
        raise ValueError("all series must have one length of at least 1")
    return low


def embeddings(spark, sf_dir: str) -> DataFrame:
    """(series_id, values, label) of ``embeddings``."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(F.col("vec_id").alias("series_id"), F.col("embedding").cast("array<double>").alias("values"), "label")


def users(spark, sf_dir: str) -> DataFrame:
    """(series_id, values): each user's values in ``events`` by time; lengths differ."""
    return collect_series(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "value", "ts", "event_id")
