"""Joins in time. Times are bigint microseconds; tolerances are too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, t: str, tolerance: int, keys: Sequence[str] = (), how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` with (``left_semi``) or without (``left_anti``) a row of ``right`` at most ``tolerance`` away.

    Time is cut into buckets of the tolerance. Of the right side, a bucket has one row: whether it has times itself, the last of
    the bucket before and the first of the one after. So it is a join of equal keys with at most one match, however many times a bucket holds.
    """
    size = max(tolerance, 1)
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    other = right.groupBy(*own, F.floor(F.col(t) / size).alias("_b")).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    sides = [
        F.struct(F.col("_b").alias("b"), F.lit(True).alias("own"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("after")),
        F.struct((F.col("_b") + 1).alias("b"), F.lit(False).alias("own"), F.col("_hi").alias("before"), F.lit(None).cast("long").alias("after")),
        F.struct((F.col("_b") - 1).alias("b"), F.lit(False).alias("own"), F.lit(None).cast("long").alias("before"), F.col("_lo").alias("after")),
    ]
    named = [f"_k{i}" for i in range(len(keys))]
    other = other.select(*named, F.explode(F.array(*sides)).alias("_s")).groupBy(*named, F.col("_s.b").alias("_b"))
    other = other.agg(F.max("_s.own").alias("_own"), F.max("_s.before").alias("_before"), F.min("_s.after").alias("_after"))
    rows = left.withColumn("_at", F.floor(F.col(t) / size))
    near = other["_own"] | (other["_before"] >= rows[t] - tolerance) | (other["_after"] <= rows[t] + tolerance)
    on = [rows[k] == other[n] for k, n in zip(keys, named, strict=True)] + [rows["_at"] == other["_b"], F.coalesce(near, F.lit(False))]
    return rows.join(other, on, how).drop("_at")


def nearest(left: DataFrame, right: DataFrame, t: str, keys: Sequence[str], value: str) -> DataFrame:
    """``left`` with ``match_t`` and ``match``: time and ``value`` of the nearest row of ``right`` with the same keys.

    The earlier one wins a tie, and the smaller value at equal times. Both sides are put in one order; a row's neighbours
    are the last match before it and the first after, so there is no join.
    """
    return _sides(left, right, t, keys, value).withColumn("_m", _closer()).select(*left.columns, "_m.match_t", "_m.match")


def backward(left: DataFrame, right: DataFrame, t: str, keys: Sequence[str], value: str) -> DataFrame:
    """``left`` with the last row of ``right`` at or before its time."""
    return _sides(left, right, t, keys, value).select(*left.columns, F.col("_before.match_t").alias("match_t"), F.col("_before.match").alias("match"))


def forward(left: DataFrame, right: DataFrame, t: str, keys: Sequence[str], value: str) -> DataFrame:
    """``left`` with the first row of ``right`` at or after its time."""
    return _sides(left, right, t, keys, value).select(*left.columns, F.col("_after.match_t").alias("match_t"), F.col("_after.match").alias("match"))


def _closer() -> Column:
    before, after = F.col("_before"), F.col("_after")
    later = before.isNull() | (after.isNotNull() & (after["match_t"] - F.col("_t") < F.col("_t") - before["match_t"]))
    return F.when(later, after).otherwise(before)


def _sides(left: DataFrame, right: DataFrame, t: str, keys: Sequence[str], value: str) -> DataFrame:
    rows = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(t).alias("_t"), F.struct(*left.columns).alias("_l"))
    other = right.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(t).alias("_t")).agg(F.min(value).alias("_v"))
    other = other.withColumn("_r", F.struct(F.col("_t").alias("match_t"), F.col("_v").alias("match"))).drop("_v")
    both = rows.unionByName(other, allowMissingColumns=True)
    by = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    up, down = by.orderBy("_t", F.col("_r").isNull()), by.orderBy(F.desc("_t"), F.col("_r").isNull())
    both = both.withColumns({"_before": F.last("_r", True).over(up.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.last("_r", True).over(down.rowsBetween(Window.unboundedPreceding, 0))})
    return both.where("_l is not null").select("_l.*", "_t", "_before", "_after")


def mean_at_offsets(matched: DataFrame, samples: DataFrame, key: Sequence[str], at: str, value: str, offsets: Sequence[int], out: str) -> DataFrame:
    """``matched`` with the mean of the samples at its index and the given offsets after it."""
    wanted = matched.select(*matched.columns, F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o")).withColumn("_at", F.col(at) + F.col("_o"))
    other = samples.select(*key, F.col(at).alias("_at"), F.col(value).alias("_v"))
    return wanted.join(other, [*key, "_at"]).groupBy(*matched.columns).agg(F.avg("_v").alias(out))


def synced(leader: DataFrame, follower: DataFrame, t: str, step: int, keys: Sequence[str], value: str) -> DataFrame:
    """Leader rows with the first follower in [t, t + ``step``), one leader for each follower: the last."""
    got = forward(leader, follower, t, keys, value).where(F.col("match_t") < F.col(t) + step)
    last = F.row_number().over(Window.partitionBy(*keys, "match_t").orderBy(F.desc(t)))
    return got.withColumn("_n", last).where("_n = 1").drop("_n")


def trials(samples: DataFrame, marks: DataFrame, t: str, keys: Sequence[str]) -> DataFrame:
    """Samples with ``trial``: how many marks of their key are at or before them (0: none yet)."""
    rows = samples.select(*samples.columns, F.lit(0).alias("_m")).unionByName(marks.select(*keys, t, F.lit(1).alias("_m")), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(t, F.desc("_m")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("trial", F.sum("_m").over(order)).where("_m = 0").drop("_m")


def crossed(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    """Each row with each of a few values from the program."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
