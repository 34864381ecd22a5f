"""Results as files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: New local folders by application, where ``spark.checkpoint.dir`` is unset.
_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that ``spark.checkpoint.dir`` names for all executors; where it is unset, in a local one of the application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        folder = _own[app]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single``: one file, for results of a few rows."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str, by: Sequence[str] = ("subject", "measure")) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def result_matrix(df: DataFrame, subject: str, measure: str, measures: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A row for each subject and value, a column for each measure: the cells of the result sheet."""
    blocks = [df.groupBy(subject).pivot(measure, list(measures)).agg(F.first(v)).withColumn("block", F.lit(v)) for v in values]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out
