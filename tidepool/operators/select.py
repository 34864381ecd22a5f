"""Projections, filters and predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.select([c for c in df.columns if not re.search(pattern, c)])


def keep_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.select([c for c in df.columns if re.search(pattern, c)])


def rename_prefixed(df: DataFrame, prefix: str, new: str) -> DataFrame:
    """``prefix...`` columns as ``new + prefix...``."""
    return df.withColumnsRenamed({c: new + c for c in df.columns if c.startswith(prefix)})


def features_and_labels(df: DataFrame, labels: Sequence[str], order: Sequence[str] | None = None, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Two projections that share ``key``: features (in ``order``, each once) and labels."""
    names = dict.fromkeys(order or [c for c in df.columns if c not in labels and c != key])
    return df.select(key, *[c for c in names if c in df.columns]), df.select(key, *[c for c in dict.fromkeys(labels) if c in df.columns])


def with_relation(df: DataFrame, affected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their ``relation`` (ipsi- or contralateral) from a small dimension."""
    return df.join(affected, list(keys))


def excluding(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which none of the conditions is true; unknown counts as not true."""
    return df.where(~F.exists(F.array(*[F.coalesce(c, F.lit(False)) for c in conditions]), lambda x: x))


def with_both_classes(df: DataFrame, group: Sequence[str], label: str, least: int = 2) -> DataFrame:
    """Groups with two classes and ``least`` labelled rows; others go."""
    ok = df.groupBy(*group).agg(F.count(label).alias("_n"), F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    return df.join(ok.where((F.col("_n") >= least) & (F.col("_lo") < F.col("_hi"))).select(*group), list(group), "left_semi")


def head(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int | Column, skip: int = 0) -> DataFrame:
    """The first ``n`` rows of each group, after ``skip`` others. ``n`` may depend on the row."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_at", at).where((F.col("_at") > skip) & (F.col("_at") <= n + skip)).drop("_at")


def capped_from(ts: str, start: str, n: int, cap: int) -> Column:
    """How many rows to take: ``cap`` at most from a date on, else ``n``."""
    return F.when(F.col(ts) >= F.lit(start).cast("timestamp"), F.least(F.lit(n), F.lit(cap))).otherwise(F.lit(n))


def without_ordinals(df: DataFrame, excluded: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows without those whose ordinal (from 1, in their group) is in ``excluded(*group, ordinal)``."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    return df.withColumn("ordinal", at).join(excluded, [*group, "ordinal"], "left_anti")


def in_order(df: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows with ``position`` of their key in an order dimension ``(key, position)``."""
    return df.join(order, key)


def overwrite_where(df: DataFrame, flagged: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """NULL in ``columns`` of the rows whose keys are in ``flagged``."""
    hit = flagged.select(*keys).distinct().withColumn("_hit", F.lit(True))
    rows = df.join(hit, list(keys), "left")
    return rows.withColumns({c: F.when(F.col("_hit").isNull(), F.col(c)) for c in columns}).drop("_hit")


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
