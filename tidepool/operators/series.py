"""Operators on ordered series: differences, smoothing, runs, folds, windows, autocovariance."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidepool.operators import agg
from tidepool.operators.models import dealt


def next_difference(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, label: str | None = None) -> DataFrame:
    """``diff`` to the next value, without the last row; ``label``: also whether it changed or increased."""
    d = F.lead(value).over(Window.partitionBy(*group).orderBy(*order)) - F.col(value)
    out = df.withColumn("diff", d).where("diff is not null")
    if label:
        out = out.withColumn("label", (F.col("diff") != 0 if label == "changed" else F.col("diff") > 0).cast("int"))
    return out


def smoothed(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, n: int, out: str) -> DataFrame:
    """Causal mean of the last ``n`` values that are there, the first one repeated before the start."""
    by = Window.partitionBy(*group).orderBy(*order)
    rows = df.where(F.col(value).isNotNull())
    last = by.rowsBetween(-(n - 1), 0)
    missing = n - F.count(value).over(last)
    first = F.first(value).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, (F.sum(value).over(last) + missing * first) / n)


def mean_gap_hours(df: DataFrame, group: Sequence[str], micros: str, span_hours: float = 72.0) -> DataFrame:
    """``gap`` (mean hours between rows, to 0.1) and ``lags`` (how many of them fill ``span_hours``)."""
    n = F.count(micros)
    gap = F.round((F.max(micros) - F.min(micros)) / (n - 1) / 3.6e9, 1)
    return df.groupBy(*group).agg(F.when(n > 1, gap).alias("gap")).withColumn("lags", F.when(F.col("gap") > 0, F.floor(span_hours / F.col("gap"))))


def without_constant_tail(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Rows up to the last one at which any value changes by more than the tolerance."""
    by = Window.partitionBy(*group).orderBy(*order)
    at = F.row_number().over(by)
    moved = F.lit(False)
    for v in values:
        moved = moved | F.coalesce(F.abs(F.col(v) - F.lag(v).over(by)) > tolerance, F.lit(True))
    rows = df.withColumns({"_at": at, "_moved": moved})
    last = rows.where("_moved").groupBy(*group).agg(F.max("_at").alias("_last"))
    return rows.join(last, list(group)).where("_at <= _last").drop("_at", "_moved", "_last")


def runs(df: DataFrame, group: Sequence[str], order: Sequence[str], up: Column) -> DataFrame:
    """Maximal runs of rows above: ``start`` and ``stop`` (ordinals from 1, stop exclusive), ``length``.

    A run that reaches the end of its series stops at the last row, so it is one shorter.
    """
    by = Window.partitionBy(*group).orderBy(*order)
    rows = df.select(*group, *order, F.coalesce(up, F.lit(False)).alias("_up"), F.row_number().over(by).alias("_at"))
    rows = rows.withColumns({"_new": (F.col("_up") & ~F.coalesce(F.lag("_up").over(by), F.lit(False))).cast("int"), "_end": F.lead("_at").over(by).isNull()})
    rows = rows.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.where("_up").groupBy(*group, "_run").agg(F.min("_at").alias("start"), F.max("_at").alias("_last"), F.bool_or("_end").alias("_end"))
    stop = F.col("_last") + F.when(F.col("_end"), 0).otherwise(1)
    return out.select(*group, "start", stop.alias("stop"), (stop - F.col("start")).alias("length"))


def bouts(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, fs: float = 1.0) -> DataFrame:
    """Runs above the group's mean: ``n_rows, bouts, mean_duration, total_time, percent``.

    A mean of doubles depends on the order in which they are added, so whether a value that equals it lies above is left to chance; of a decimal ``value``, sums are exact.
    """
    means = df.groupBy(*group).agg(F.avg(value).alias("_mean"), F.sum(value).alias("_sum"), F.count(value).alias("_there"), F.count(F.lit(1)).alias("n_rows"))
    exact = dict(df.dtypes)[value].startswith("decimal")
    up = F.col(value) * F.col("_there").cast("decimal(12,0)") > F.col("_sum") if exact else F.col(value) > F.col("_mean")
    found = runs(df.join(means, list(group)), group, order, up)
    stats = found.groupBy(*group).agg(F.count(F.lit(1)).alias("bouts"), F.avg(F.col("length") / fs).alias("mean_duration"), F.sum(F.col("length") / fs).alias("total_time"))
    total = F.coalesce("total_time", F.lit(0.0))
    return means.join(stats, list(group), "left").select(
        *group, "n_rows", F.coalesce("bouts", F.lit(0)).alias("bouts"), "mean_duration", total.alias("total_time"), (100 * total / (F.col("n_rows") / fs)).alias("percent")
    )


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "i") -> DataFrame:
    """Rows with their ordinal in the group, from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long"))


def leave_one_out(df: DataFrame, group: Sequence[str], i: str, gap: int = 0) -> DataFrame:
    """``fold, first, last, n_train`` of leave-one-out with ``gap`` excluded rows on either side, cut at the ends.

    Training rows are those outside first .. last: a range says it, so no fold's rows are listed.
    """
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    rows = df.select(*group, F.col(i).alias("fold")).join(n, list(group))
    first, last = F.greatest(F.col("fold") - gap, F.lit(0)), F.least(F.col("fold") + gap, F.col("_n") - 1)
    return rows.select(*group, "fold", first.alias("first"), last.alias("last"), (F.col("_n") - (last - first + 1)).alias("n_train"))


def k_folds(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int, seed: int | None = None) -> DataFrame:
    """Rows with ``fold`` (from 1): parts that follow each other, the larger ones first; with a ``seed``, of rows in a random order that follows from it."""
    by = [F.xxhash64(F.lit(seed), *order), *order] if seed is not None else order
    return df.withColumn("fold", F.ntile(k).over(Window.partitionBy(*group).orderBy(*by)))


def by_time(df: DataFrame, *order: str) -> DataFrame:
    """Rows in order of time, sorted in ranges."""
    return df.orderBy(*order)


def far_from_test(df: DataFrame, group: Sequence[str], i: str, fold: str, distance: int) -> DataFrame:
    """``test_fold``, row ordinal: training rows at least ``distance`` from every test row, for folds that follow each other."""
    ranges = df.groupBy(*group, F.col(fold).alias("test_fold")).agg(F.min(i).alias("_a"), F.max(i).alias("_b"))
    rows = df.select(*group, i).join(ranges, list(group))
    return rows.where((F.col(i) <= F.col("_a") - distance) | (F.col(i) >= F.col("_b") + distance)).drop("_a", "_b")


def chronological_split(df: DataFrame, group: Sequence[str], order: Sequence[str], test_share: float = 0.3) -> DataFrame:
    """Rows with ``is_test``: the last ``ceil(test_share * n)`` of each group."""
    rows = numbered(df, group, order, "_i").join(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), list(group))
    return rows.withColumn("is_test", F.col("_i") >= F.col("_n") - F.ceil(F.col("_n") * test_share)).drop("_i", "_n")


def mid_ranks(df: DataFrame, group: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1, equal values with their mean rank; made of counts of distinct values."""
    c = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_k"))
    up = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn(out, F.sum("_k").over(up) - (F.col("_k") - 1) / 2).drop("_k")
    return df.join(c, [*group, value])


def sliding(df: DataFrame, key: Sequence[str], values: str, length: int, step: int, whole: bool = True) -> DataFrame:
    """``window`` (from 0), ``start`` (from 0) and ``values`` of windows over an array column; incomplete ones go."""
    n = F.floor((F.size(values) - length) / step)
    rows = df.where(F.size(values) >= length).withColumn("window", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    start = F.col("window") * step
    return rows.select(*key, "window", start.alias("start"), F.slice(values, start + 1, length).alias("values"))


def tumbling(df: DataFrame, group: Sequence[str], i: str, length: int, *aggregates: Column) -> DataFrame:
    """Aggregates of whole blocks of ``length`` ordinals; the incomplete last one goes."""
    at = F.floor(F.col(i) / length).alias("window")
    return df.groupBy(*group, at).agg(F.count(F.lit(1)).alias("_n"), *aggregates).where(F.col("_n") == length).drop("_n")


def autocovariance(df: DataFrame, group: Sequence[str], i: str, value: str, lags: int, mode: str = "biased") -> DataFrame:
    """``lag, acov, n`` for 0 .. ``lags`` of the centered series; missing values are skipped. ``n``: the series' values that are there.

    ``biased`` divides by n, ``unbiased`` by the number of products, ``coeff`` by lag 0. Each row meets ``lags`` others of its
    series through the window, so there is no join.
    """
    means = df.groupBy(*group).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"), F.count(value).alias("_there"))
    by = Window.partitionBy(*group).orderBy(i)
    rows = df.join(means, list(group)).withColumn("_x", F.col(value) - F.col("_m"))
    ahead = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("_x") * F.lead("_x", k).over(by)).alias("p")) if k else F.struct(F.lit(0).alias("lag"), (F.col("_x") * F.col("_x")).alias("p")) for k in range(lags + 1)])
    rows = rows.select(*group, "_n", "_there", ahead.alias("_a")).select(*group, "_n", "_there", F.explode("_a").alias("e"))
    out = rows.groupBy(*group, "e.lag").agg(F.sum("e.p").alias("_s"), F.count("e.p").alias("_k"), F.first("_n").alias("_n"), F.first("_there").alias("n"))
    if mode == "unbiased":
        return out.select(*group, "lag", (F.col("_s") / F.col("_k")).alias("acov"), "n")
    if mode == "coeff":
        zero = out.where("lag = 0").select(*group, F.col("_s").alias("_z"))
        return out.join(zero, list(group)).select(*group, "lag", (F.col("_s") / F.col("_z")).alias("acov"), "n")
    return out.select(*group, "lag", (F.col("_s") / F.col("_n")).alias("acov"), "n")


#: Rows of a series that one task correlates at once.
BLOCK_ROWS = 1 << 16


def autocovariance_by_blocks(df: DataFrame, group: Sequence[str], i: str, value: str, lags: int, mode: str = "biased", block: int = BLOCK_ROWS) -> DataFrame:
    """``autocovariance`` of series of any length and for many lags: a task has one block of a series and the ``lags`` rows after it, and correlates them by Fourier transforms.

    ``i`` orders a series' rows and is distinct in it. Places come from counts of ranges (see ``agg.cumulated``), so no task puts a whole series in order; a block gives one
    sum for each lag, and these are added. Missing values are skipped, as zeros in the sums and in the numbers of products.
    """
    means = df.groupBy(*group).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"), F.count(value).alias("_there"))
    places = agg.cumulated(df.select(*group, i), group, i).select(*group, i, (F.col("_c") - 1).alias("_at"))
    rows = df.select(*group, i, value).join(places, [*group, i]).join(means.select(*group, "_m"), list(group))
    rows = rows.select(*group, "_at", (F.col(value) - F.col("_m")).cast("double").alias("_x"), F.floor(F.col("_at") / block).alias("_block"))
    first = F.floor(F.greatest(F.col("_at") - lags, F.lit(0)) / block)
    rows = rows.withColumn("_block", F.explode(F.sequence(first, F.col("_block"))))
    kinds = dict(df.dtypes)

    def correlate(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["_at"].to_numpy() - int(rows["_block"].iloc[0]) * block
        length = int(at.max()) + 1  # of a short series, not the block's
        x = np.full(length, np.nan)
        x[at] = rows["_x"].to_numpy(float)
        there = (~np.isnan(x)).astype(float)
        x = np.where(there > 0, x, 0.0)
        size = 1 << int(np.ceil(np.log2(length + min(length, block))))

        def against(v: np.ndarray) -> np.ndarray:
            made = np.zeros(lags + 1)
            some = min(lags + 1, length)
            made[:some] = np.fft.irfft(np.conj(np.fft.rfft(v[:block], size)) * np.fft.rfft(v, size), size)[:some]
            return made

        made = {"lag": np.arange(lags + 1), "_s": against(x), "_k": np.rint(against(there)).astype(np.int64)}
        return pd.DataFrame({**{g: [rows[g].iloc[0]] * (lags + 1) for g in group}, **made})

    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "lag int, _s double, _k long"])
    sums = dealt(rows, *group, "_block").groupBy(*group, "_block").applyInPandas(correlate, schema).groupBy(*group, "lag").agg(F.sum("_s").alias("_s"), F.sum("_k").alias("_k"))
    out = sums.join(means.select(*group, "_n", F.col("_there").alias("n")), list(group)).withColumn("_s", F.when(F.col("_k") > 0, F.col("_s")))
    if mode == "coeff":
        zero = sums.where("lag = 0").select(*group, F.col("_s").alias("_z"))
        return out.join(zero, list(group)).select(*group, "lag", (F.col("_s") / F.col("_z")).alias("acov"), "n")
    return out.select(*group, "lag", (F.col("_s") / (F.col("_k") if mode == "unbiased" else F.col("_n"))).alias("acov"), "n")


def partial_autocorrelation(acov: DataFrame, group: Sequence[str], n: int | str = "n") -> DataFrame:
    """``lag, pacf, significant`` by the Durbin-Levinson recursion over a series' few autocovariances; ``n``: its length, or the column that has it."""
    import numpy as np
    import pandas as pd

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        c = rows.sort_values("lag")["acov"].to_numpy()
        size = rows[n].iloc[0] if isinstance(n, str) else n
        a, e, out = np.zeros(0), c[0], []
        for k in range(1, len(c)):
            r = (c[k] - a @ c[k - 1 : 0 : -1]) / e if e > 0 else 0.0
            a, e = np.append(a - r * a[::-1], r), e * (1 - r * r)
            out.append(r)
        limit = 1.959963984540054 / np.sqrt(np.maximum(size - 1 - np.arange(1, len(c)), 1))
        keys = {g: rows[g].iloc[0] for g in group}
        return pd.DataFrame({**keys, "lag": np.arange(1, len(c)), "pacf": out, "significant": np.abs(out) > limit})

    kinds = dict(acov.dtypes)
    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "lag int, pacf double, significant boolean"])
    return acov.groupBy(*group).applyInPandas(solve, schema)


def resampled(df: DataFrame, group: Sequence[str], t: str, value: str, step: int) -> DataFrame:
    """``t, value`` on a uniform grid, by monotone cubic interpolation between the neighbours of each grid point.

    A row carries its two neighbours on either side, so the points between it and the next come from that row alone and
    a series is never gathered. Slopes are the weighted harmonic means of the secants, zero at turning points.
    """
    by = Window.partitionBy(*group).orderBy(t)
    rows = df.where(F.col(value).isNotNull()).groupBy(*group, t).agg(F.avg(value).alias("y")).withColumnRenamed(t, "x")
    by = Window.partitionBy(*group).orderBy("x")
    near = {f"{c}{k}": F.lead(c, k).over(by) for c in ("x", "y") for k in (-1, 1, 2)}
    start = F.min("x").over(Window.partitionBy(*group))
    rows = rows.withColumns({**near, "origin": start}).where("x1 is not null")

    def secant(a: str, b: str) -> Column:
        return (F.col("y" + b) - F.col("y" + a)) / (F.col("x" + b) - F.col("x" + a))

    h, d = F.col("x1") - F.col("x"), secant("", "1")

    def slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
        w0, w1 = 2 * h1 + h0, h1 + 2 * h0
        return F.when(d0 * d1 <= 0, 0.0).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))

    def end_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return F.when(d1.isNull(), d0).when(s * d0 <= 0, 0.0).when((d0 * d1 <= 0) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)

    h_before, d_before = F.col("x") - F.col("x-1"), secant("-1", "")
    h_after, d_after = F.col("x2") - F.col("x1"), secant("1", "2")
    m0 = F.when(F.col("x-1").isNull(), end_slope(h, d, h_after, d_after)).otherwise(slope(h_before, d_before, h, d))
    m1 = F.when(F.col("x2").isNull(), end_slope(h, d, h_before, d_before)).otherwise(slope(h, d, h_after, d_after))
    first = F.ceil((F.col("x") - F.col("origin")) / step)
    last = F.ceil((F.col("x1") - F.col("origin")) / step) - F.when(F.col("x2").isNull(), F.when((F.col("x1") - F.col("origin")) % step == 0, 0).otherwise(1)).otherwise(1)
    rows = rows.withColumns({"m0": m0, "m1": m1, "h": h}).where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    at = F.col("origin") + F.col("k") * step
    s = (at - F.col("x")) / F.col("h")
    y = (
        (1 + 2 * s) * (1 - s) * (1 - s) * F.col("y")
        + s * (1 - s) * (1 - s) * F.col("h") * F.col("m0")
        + s * s * (3 - 2 * s) * F.col("y1")
        + s * s * (s - 1) * F.col("h") * F.col("m1")
    )
    return rows.select(*group, at.alias("t"), y.alias("value"))


def sliding_rows(df: DataFrame, key: str, i: str, value: str, length: int, step: int) -> DataFrame:
    """``sliding`` over rows in place of an array: a table function that gets each ``key``'s rows in order of ``i`` and holds the last ``length`` of them.

    A series may so be as long as it likes. A null value is one of a window's, as null; a null key is a key.
    """

    class Sliding:
        def __init__(self) -> None:
            self.held: deque = deque(maxlen=length)
            self.seen = 0

        def eval(self, row: Row) -> Iterator[tuple]:
            self.held.append(row[value])
            self.seen += 1
            start = self.seen - length
            if start >= 0 and start % step == 0:
                yield row[key], start // step, start, list(self.held)

    schema = f"{key} {dict(df.dtypes)[key]}, window int, start int, values array<double>"
    rows = df.select(key, i, F.col(value).cast("double").alias(value))
    return F.udtf(Sliding, returnType=schema)(rows.asTable().partitionBy(key).orderBy(i))
