"""Sorting with ranks, top rows, unions, pivots and repetition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_ranks(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Rows with their place in the group's order, from 1: the inverse of the sorting permutation."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def top(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    return order_ranks(df, group, order).where(F.col("rank") <= k)


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def melted(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivoted(df: DataFrame, key: Sequence[str], column: str, names: Sequence, value: Column) -> DataFrame:
    return df.groupBy(*key).pivot(column, list(names)).agg(value)


def transposed(df: DataFrame, key: str, names: Sequence[str], keys: Sequence) -> DataFrame:
    """A small matrix with its columns as rows; ``keys``: the values of ``key``, which become columns."""
    return melted(df, [key], names, "name", "_v").groupBy("name").pivot(key, list(keys)).agg(F.first("_v"))


def repeated(df: DataFrame, times: str | int) -> DataFrame:
    """Each row k times, k from a column or fixed."""
    k = F.lit(times) if isinstance(times, int) else F.col(times)
    return df.where(k > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), k.cast("int"))))
