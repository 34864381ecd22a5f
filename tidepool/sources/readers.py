"""Files of recordings and surveys as DataFrames: explicit schemas, NaN as NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.columns import nan_to_null


def read_json_records(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """An array of records (or a record a line); NaN, and empty cells, become NULL."""
    return nan_to_null(spark.read.schema(schema).option("multiLine", multi_line).option("allowNonNumericNumbers", True).option("mode", "PERMISSIVE").json(path))


def read_timetable(spark: SparkSession, path: str, schema: str, time: str, needed: Sequence[str], first: Sequence[str] = (), multi_line: bool = True) -> DataFrame:
    """Records with ``time`` as a timestamp, without those that lack a ``needed`` value; ``first`` columns lead."""
    df = read_json_records(spark, path, schema, multi_line).withColumn(time, F.try_to_timestamp(time)).dropna(subset=[time, *needed])
    lead = [time, *first]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def read_csv_table(spark: SparkSession, path: str, schema: str, index_column: str | None = None) -> DataFrame:
    """A CSV with a header; the index column that a data frame's writer leaves in front is dropped."""
    df = nan_to_null(spark.read.schema(schema).option("header", True).csv(path))
    return df.drop(index_column) if index_column else df


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recordings as Parquet (see FIXTURES.md, 1.4)."""
    return spark.read.parquet(path)


def channels_assembled(df: DataFrame, key: Sequence[str], channel: str, names: Sequence[str], value: str) -> DataFrame:
    """Long samples as a row for each key with ``values``: one number for each channel, in order."""
    wide = df.groupBy(*key).pivot(channel, list(names)).agg(F.first(value))
    return wide.select(*key, F.array(*names).alias("values"))


def linear_target(df: DataFrame, x: str, weights: Sequence[float], noise: float, seed: int = 0) -> DataFrame:
    """Rows with ``y`` = x . weights + noise."""
    dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("y", dot + F.randn(seed) * noise)


def linear_data(spark: SparkSession, rows: int, weights: Sequence[float], noise: float, seed: int = 0) -> DataFrame:
    """``id, x, y``: normal features and y = x . weights + noise."""
    x = F.array(*[F.randn(seed + i) for i in range(len(weights))])
    return linear_target(spark.range(rows).withColumn("x", x), "x", weights, noise, seed + len(weights))
