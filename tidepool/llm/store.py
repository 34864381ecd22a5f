"""Intermediate tables in the cluster's shared folder, and identities of rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: New local folders by application, where ``spark.checkpoint.dir`` is unset.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests), a new local one for the application, unless executors couldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        folder = _own[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again; ``level``: of its compression.

    Its lineage ends there: later stages and the loss of an executor re-read the files and do not
    compute them again.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes what ``written`` has written for ``tables``, once nothing is to be read from it any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if not re.search("-[0-9a-f]{32}$", folder):
                raise ValueError(f"{folder} isn't a folder of an intermediate table")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit fingerprints of a text (null: as empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(7919), text).alias("key_b")]


def with_text(rows: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The columns ``names`` of ``_doc`` with ``_text`` as their ``text``, and its length as ``n_chars``, if there is one; then ``more``.

    A document's own columns stay in a struct till here, so that no other name can meet theirs.
    """
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in names], *more)
