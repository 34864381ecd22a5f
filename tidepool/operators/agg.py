"""Null-aware aggregates. NaN should be NULL (see ``nan_to_null``); NULL is skipped.

Statistics of a group go to its rows by a join, not by a window over the group, so a group's rows are never sorted or
held together; medians and percentiles are exact by default, from counts of distinct values, and approximate with ``approx``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that a round of ``order_statistics`` deals a group's values into.
SELECT_RANGES = 64
#: Input from which values are narrowed down before they are sorted, and so often; Spark's estimate decides, and results are the same.
SELECT_BYTES = 256 << 20
SELECT_ROUNDS = 2


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _narrowed(values: DataFrame, keys: Sequence[str], group: Sequence[str], value: str, wanted: DataFrame, level: int) -> DataFrame:
    """Of ``keys, value, _k, _base``, the values of those ranges that hold a wanted place, with the range as a further key and in ``_base`` the number of values before it.

    Ranges lie between approximate percentiles of the distinct values; their counts are summed in the tasks that hold the values, and only
    these counts, ``SELECT_RANGES`` of a key at most, are put in order.
    """
    name = f"_r{level}"
    cuts = values.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(i / SELECT_RANGES) for i in range(1, SELECT_RANGES)]), F.lit(1000)).alias("_cuts"))
    ranged = values.join(cuts, list(keys)).withColumn(name, F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    counts = ranged.groupBy(*keys, name).agg(F.sum("_k").alias("_s"), F.first("_base").alias("_b"))
    lower = F.sum("_s").over(Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_b", F.col("_b") + F.coalesce(lower, F.lit(0))).join(wanted, list(group))
    kept = counts.where(F.exists("_places", lambda t: (t >= F.col("_b")) & (t < F.col("_b") + F.col("_s")))).select(*keys, name, "_b")
    return ranged.drop("_base").join(kept, [*keys, name]).withColumnRenamed("_b", "_base")


def order_statistics(df: DataFrame, group: Sequence[str], value: str, at: Mapping[str, Column], *more: str, rounds: int | None = None, weight: str | None = None) -> DataFrame:
    """The values at places in each group's order, interpolated: ``at`` has them from 0, as expressions of ``_n``, the values that are there.

    Values are counted before they are shuffled. Rounds of selection (see ``_narrowed``) keep only the values about the places, some 1 / ``SELECT_RANGES`` of them for each
    place and round, so no task sorts a large group; ``rounds`` None: none for inputs that are estimated below ``SELECT_BYTES``. A window adds up the counts of
    what is left, and one aggregation picks the values at the places; ``_n`` and ``_distinct`` come too if ``more`` names them. A row stands for as many
    values as ``weight`` says, a whole number from 1 on.
    """
    if not group:
        return order_statistics(df.withColumn("_all", F.lit(0)), ["_all"], value, at, *more, rounds=rounds, weight=weight).drop("_all")
    if rounds is None:
        rounds = SELECT_ROUNDS if _estimated_bytes(df.select(*group, value)) > SELECT_BYTES else 0
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_k"))
    totals = counts.groupBy(*group).agg(F.sum("_k").alias("_n"), F.count(F.lit(1)).alias("_distinct"))
    places = [p for place in at.values() for p in (F.floor(place), F.least(F.floor(place) + 1, F.col("_n") - 1))]
    wanted, keys = totals.select(*group, F.array(*[p.cast("long") for p in places]).alias("_places")), list(group)
    counts = counts.withColumn("_base", F.lit(0).cast("long"))
    for level in range(rounds):
        counts = _narrowed(counts, keys, group, value, wanted, level)
        keys = [*keys, f"_r{level}"]
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_c", F.col("_base") + F.sum("_k").over(up)).join(totals, list(group))
    found, places = [F.first(c).alias(c) for c in ("_n", "_distinct")], {}
    for name, place in at.items():
        lo = F.floor(place)
        found += [F.min(F.when(F.col("_c") > lo, F.col(value))).alias(f"_{name}_lo"), F.min(F.when(F.col("_c") > F.least(lo + 1, F.col("_n") - 1), F.col(value))).alias(f"_{name}_hi")]
        places[name] = F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (place - lo)
    picked = counts.groupBy(*group).agg(*found)
    return picked.select(*group, *more, *[c.alias(n) for n, c in places.items()])


def percentiles(df: DataFrame, group: Sequence[str], value: str, shares: Mapping[str, float], approx: bool = False, rounds: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact (or approximate) percentiles of each group, interpolated between the values about them; ``rounds``, ``weight``: see ``order_statistics``."""
    if approx:
        return df.groupBy(*group).agg(*[F.percentile_approx(value, p, 10_000).alias(n) for n, p in shares.items()])
    return order_statistics(df, group, value, {n: (F.col("_n") - 1) * F.lit(p) for n, p in shares.items()}, rounds=rounds, weight=weight)


def joined(df: DataFrame, stats: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with their group's statistics; null where a group has none."""
    return df.join(stats, list(group), "left") if group else df.join(F.broadcast(stats), how="left")


def joined_in_parts(df: DataFrame, stats: DataFrame, group: Sequence[str], by: str, parts: int = 32) -> DataFrame:
    """Rows with their group's statistics, of few columns; none where a group has none. A group's rows are dealt to many tasks, by ``by``: a few large groups would else be sorted in a task each."""
    copies = stats.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return df.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).join(copies, [*group, "_part"]).drop("_part")


def with_stats(df: DataFrame, group: Sequence[str], **stats: Column) -> DataFrame:
    """Rows with their group's aggregates."""
    found = df.groupBy(*group).agg(*[c.alias(k) for k, c in stats.items()])
    return df.join(found, list(group)) if group else df.join(F.broadcast(found))


def skip_sums(df: DataFrame, group: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """``total, n, ssq`` of the values that are there; weighted, ``n`` is the sum of their weights."""
    v, w = F.col(value), F.lit(1.0) if weight is None else F.when(F.col(value).isNotNull(), F.col(weight))
    n = F.count(value) if weight is None else F.sum(w)
    return df.groupBy(*group).agg(F.sum(v * w).alias("total"), n.alias("n"), F.sum(v * v * w).alias("ssq"))


def sem(value: str, all_rows: bool = False) -> Column:
    """Standard error of the mean, over the values that are there or over all rows."""
    return F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)) if all_rows else F.count(value))


def z_scores(df: DataFrame, group: Sequence[str], value: str, out: str, ddof: int = 1) -> DataFrame:
    sd = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    rows = with_stats(df, group, _m=F.avg(value), _s=sd)
    return rows.withColumn(out, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def scaler(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``mean`` and ``scale`` (population deviation; 1 where it is 0) of each group, to apply to any table."""
    sd = F.stddev_pop(value)
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("scale"))


def scaled(df: DataFrame, fitted: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    return df.join(fitted, list(group)).withColumn(out, (F.col(value) - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def l2_normalised(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    return with_stats(df, group, _q=F.sqrt(F.sum(F.col(value) * F.col(value)))).withColumn(out, F.col(value) / F.col("_q")).drop("_q")


def median_split(df: DataFrame, group: Sequence[str], value: str, out: str, strict: bool = False, approx: bool = False) -> DataFrame:
    """1 where the value is at least (``strict``: above) its group's median, 0 where not, NULL where it is missing."""
    rows = joined(df, percentiles(df, group, value, {"_m": 0.5}, approx), group)
    hit = F.col(value) > F.col("_m") if strict else F.col(value) >= F.col("_m")
    return rows.withColumn(out, hit.cast("int")).drop("_m")


def histogram(df: DataFrame, group: Sequence[str], value: str, low: float, high: float, bins: int, density: bool = False) -> DataFrame:
    """``bin`` (from 0), ``center``, ``n`` and ``share`` (or density) over equal bins; the last one is closed. Empty bins aren't listed."""
    width = (high - low) / bins
    rows = df.where((F.col(value) >= low) & (F.col(value) <= high))
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counted = rows.groupBy(*group, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counted = with_stats(counted, group, _t=F.sum("n"))
    share = F.col("n") / F.col("_t") / (width if density else 1.0)
    return counted.select(*group, "bin", (low + (F.col("bin") + 0.5) * width).alias("center"), "n", share.alias("share"))


def auto_bins(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``n, distinct, discrete, bins`` of each group, as the automatic histogram chooses them.

    Values are discrete if fewer than a third are distinct. Under 20 values have n / 4 bins; else the width is
    2 IQR / n^(1/3), with quartiles that interpolate at (i - 0.5) / n.
    """

    def place(p: float) -> Column:
        return F.greatest(F.lit(1.0), F.least(F.col("_n") * p + 0.5, F.col("_n").cast("double"))) - 1

    last = (F.col("_n") - 1).cast("double")
    found = order_statistics(df, group, value, {"q1": place(0.25), "q3": place(0.75), "least": F.lit(0.0), "most": last}, "_n", "_distinct")
    width = 2 * (F.col("q3") - F.col("q1")) / F.pow(F.col("_n"), F.lit(1 / 3))
    bins = F.when(F.col("_n") < 20, F.ceil(F.col("_n") / 4)).when(width > 0, F.round((F.col("most") - F.col("least")) / width)).otherwise(1)
    return found.select(*group, F.col("_n").alias("n"), F.col("_distinct").alias("distinct"), (F.col("_distinct") < F.col("_n") / 3).alias("discrete"), bins.cast("long").alias("bins"))


def kernel_density(df: DataFrame, group: Sequence[str], value: str, grid: Sequence[float], width: float) -> DataFrame:
    """``x, density`` at each point of a small grid: a sum of normal kernels over the group's values, in one pass."""
    points = df.where(F.col(value).isNotNull()).withColumn("x", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    z = (F.col("x") - F.col(value)) / width
    return points.groupBy(*group, "x").agg((F.avg(F.exp(-z * z / 2)) / (width * 2.5066282746310002)).alias("density"))


def smooth_histogram(df: DataFrame, group: Sequence[str], value: str, low: float, high: float, points: int = 100, stiffness: float = 10.0) -> DataFrame:
    """``x, density``: the slope of a smoothed cumulative share, on a uniform grid.

    Values are counted by grid cell first, so a task smooths ``points`` numbers, however many values there are. The curve
    is the one that minimises its squared distance to the shares plus ``stiffness`` times its squared second differences.
    """
    import numpy as np
    import pandas as pd

    counted = histogram(df, group, value, low, high, points)
    kinds = dict(counted.dtypes)
    width = (high - low) / points
    bend = np.diff(np.eye(points + 1), 2, axis=0)
    smoother = np.linalg.inv(np.eye(points + 1) + stiffness * bend.T @ bend)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        share = np.zeros(points)
        share[rows["bin"]] = rows["share"]
        slope = np.diff(smoother @ np.append(0, np.cumsum(share))) / width
        x = low + (np.arange(points) + 0.5) * width
        return pd.DataFrame({**{g: [rows[g].iloc[0]] * points for g in group}, "x": x, "density": np.maximum(slope, 0)})

    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "x double, density double"])
    return counted.groupBy(*group).applyInPandas(run, schema)


def cumulated(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``group, value, _k, _c, _n``: distinct values, how often they come, how many are as low, and the group's number; no task puts a whole group in order.

    Values are dealt into ranges between approximate percentiles, and the counts of lower ranges are added.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_k"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx(value, F.array(*[F.lit(i / SELECT_RANGES) for i in range(1, SELECT_RANGES)]), F.lit(1000)).alias("_cuts"))
    ranged = counts.join(cuts, list(group)).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = ranged.groupBy(*group, "_r").agg(F.sum("_k").alias("_s"))
    lower = F.sum("_s").over(Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*group, "_r", F.coalesce(lower, F.lit(0)).alias("_b"), F.sum("_s").over(Window.partitionBy(*group)).alias("_n"))
    inside = F.sum("_k").over(Window.partitionBy(*group, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(sums, [*group, "_r"]).withColumn("_c", F.col("_b") + inside).select(*group, value, "_k", "_c", "_n")


def spline_density(df: DataFrame, group: Sequence[str], value: str, knots: int = 1000) -> DataFrame:
    """``x, density`` of each group: the slope of a cubic smoothing spline through its cumulative counts, at the knots, scaled to the group's number of values.

    Knots are every ``floor(n / knots)``-th value in order, at least each one, so fewer than twice ``knots``; equal ones are one knot with their number as its weight and their mean
    count. The stiffness is the cubed mean distance of knots over 0.0006. Groups of fewer than two knots have no density (null). Nulls are skipped.
    """
    import numpy as np
    import pandas as pd

    from tidepool.functions.splines import smoothing_spline

    step = F.greatest(F.floor(F.col("_n") / knots), F.lit(1))
    low = F.col("_c") - F.col("_k")  # places are 0, step, 2 step, ...: those from low up to _c are the value's
    first, beyond = F.ceil(low / step), F.ceil(F.col("_c") / step)
    rows = cumulated(df, group, value).withColumns({"_w": beyond - first, "_y": (first + beyond - 1) / 2 * step + 1}).where("_w > 0")
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(value)
        x, y, w, n = (rows[c].to_numpy(float) for c in (value, "_y", "_w", "_n"))
        density = np.full(len(x), np.nan)
        if len(x) > 1:
            apart = np.diff(np.repeat(x, w.astype(int))).mean()
            density = smoothing_spline(x, y, w, apart**3 / 0.0006)[1]
            density = density * n[0] / np.trapezoid(density, x)
        return pd.DataFrame({**{g: rows[g].to_numpy() for g in group}, "x": x, "density": density})

    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "x double, density double"])
    made = rows.select(*group, F.col(value).cast("double").alias(value), "_y", "_w", "_n").groupBy(*group).applyInPandas(run, schema)
    return made.withColumn("density", F.when(~F.isnan("density"), F.col("density")))


def entries(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct values with ``n`` and ``rank`` (from 1, in order), nulls as one."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.dense_rank().over(Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last())))


def weighted_stats(df: DataFrame, group: Sequence[str], value: str, weight: str) -> DataFrame:
    """``mean``, ``std_of_mean`` and ``std_of_sample`` under weights."""
    ok = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    mean = F.sum(F.col(weight) * F.col(value)) / F.sum(weight)
    found = with_stats(ok, group, _w=mean)
    d = F.col(value) - F.col("_w")
    n, total, ssq = F.count(value), F.sum(weight), F.sum(F.col(weight) * d * d)
    return found.groupBy(*group).agg(F.first("_w").alias("mean"), F.sqrt(ssq / total / (n - 1)).alias("std_of_mean"), F.sqrt(ssq / total * n / (n - 1)).alias("std_of_sample"))


def weighted_median(counts: DataFrame, group: Sequence[str], value: str, n: str) -> DataFrame:
    """The first value at which the cumulative count reaches half, from a table of distinct values."""
    up = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = counts.groupBy(*group).agg(F.sum(n).alias("_t"))
    cumulated = counts.withColumn("_c", F.sum(n).over(up)).join(total, list(group))
    return cumulated.where(F.col("_c") * 2 >= F.col("_t")).groupBy(*group).agg(F.min(value).alias("weighted_median"))


def fit_quality(df: DataFrame, group: Sequence[str], truth: str, guess: str) -> DataFrame:
    """``r2`` (1 - SSE / SST), ``rmse`` and ``r`` of predictions."""
    e = F.col(truth) - F.col(guess)
    both = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    sst = F.var_pop(truth) * F.count(truth)
    return both.groupBy(*group).agg((1 - F.sum(e * e) / sst).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(truth, guess).alias("r"))


def confusion(df: DataFrame, group: Sequence[str], truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """``tp, fp, tn, fn`` and the rates from them, of scores at or above a threshold."""
    said, is_ = F.col(score) >= threshold, F.col(truth) == 1
    c = df.groupBy(*group).agg(
        F.count_if(said & is_).alias("tp"), F.count_if(said & ~is_).alias("fp"), F.count_if(~said & ~is_).alias("tn"), F.count_if(~said & is_).alias("fn")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns(
        {"sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "ppv": ratio(tp, tp + fp), "fpr": ratio(fp, tn + fp), "accuracy": (tp + tn) / (tp + fp + tn + fn)}
    )


def cohen_d(df: DataFrame, group: Sequence[str], value: str, label: str) -> DataFrame:
    one, zero = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    spread = F.sqrt((F.var_samp(one) + F.var_samp(zero)) / 2)
    return df.groupBy(*group).agg(((F.avg(one) - F.avg(zero)) / spread).alias("cohen_d"))


def chi_square(df: DataFrame, group: Sequence[str], row: str, column: str) -> DataFrame:
    """``chi2`` and ``dof`` of a contingency table: n x (the sum of o^2 / (row sum x column sum) - 1), so empty cells aren't listed."""
    keys = list(group)
    cells = df.groupBy(*keys, row, column).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(*keys, row).agg(F.sum("o").alias("r"))
    columns = cells.groupBy(*keys, column).agg(F.sum("o").alias("c"))
    full = cells.join(rows, [*keys, row]).join(columns, [*keys, column])
    n = F.sum("o")
    chi2 = n * (F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))) - 1)
    return full.groupBy(*keys).agg(chi2.alias("chi2"), ((F.countDistinct(row) - 1) * (F.countDistinct(column) - 1)).alias("dof"))


def within_iqr(df: DataFrame, group: Sequence[str], value: str, times: float = 10.0, approx: bool = False) -> DataFrame:
    """Rows whose value is within ``times`` interquartile ranges of the quartiles."""
    rows = joined(df, percentiles(df, group, value, {"_a": 0.25, "_b": 0.75}, approx), group)
    room = (F.col("_b") - F.col("_a")) * times
    return rows.where((F.col(value) >= F.col("_a") - room) & (F.col(value) <= F.col("_b") + room)).drop("_a", "_b")


def noisy_samples(df: DataFrame, channel: Sequence[str], sample: Sequence[str], value: str, k: float) -> DataFrame:
    """Samples at which any channel exceeds ``k`` times its variance."""
    rows = with_stats(df, channel, _v=F.var_samp(value))
    flagged = rows.groupBy(*sample).agg(F.bool_or(F.abs(value) > F.col("_v") * k).alias("noisy"))
    return flagged.where("noisy").select(*sample)


def max_normalised(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    return with_stats(df, group, _x=F.max(value)).withColumn(out, F.col(value) / F.col("_x")).drop("_x")


def min_max_scaled(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Values scaled to -1 .. 1."""
    rows = with_stats(df, group, _a=F.min(value), _b=F.max(value))
    return rows.withColumn(out, 2 * (F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) - 1).drop("_a", "_b")


def curves(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, standard error and number at each point."""
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), sem(value).alias("sem"), F.count(value).alias("n"))


def curves_by(df: DataFrame, group: Sequence[str], value: str, handles: Mapping[str, Callable[[Any], float]]) -> DataFrame:
    """``curves`` with functions of one's own: each gets a point's values that are there, as a NumPy array, and gives a number; null where there are none, or no number comes out.

    A point's values are in one task, as a function may need them all; what Spark's aggregates can say should be said with them.
    """
    import numpy as np
    import pandas as pd

    def aggregate(function: Callable[[Any], float]):
        def run(values: pd.Series) -> float:
            there = values.to_numpy(float)
            there = there[~np.isnan(there)]
            found = float(function(there)) if len(there) else float("nan")
            return None if np.isnan(found) else found

        return F.pandas_udf(run, "double", F.PandasUDFType.GROUPED_AGG)

    return df.groupBy(*group).agg(*[aggregate(f)(F.col(value).cast("double")).alias(n) for n, f in handles.items()])


def score_counts(df: DataFrame, group: Sequence[str], label: str, score: str) -> DataFrame:
    """``pos`` and ``neg`` rows of each distinct score: all that ROC curves need, counted in the tasks first."""
    ok = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return ok.groupBy(*group, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def auc(df: DataFrame, group: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in order, ties as half."""
    up = Window.partitionBy(*group).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    c = score_counts(df, group, label, score).withColumn("_below", F.sum("neg").over(up) - F.col("neg") / 2)
    p, n = F.sum("pos"), F.sum("neg")
    return c.groupBy(*group).agg(F.when((p > 0) & (n > 0), F.sum(F.col("pos") * F.col("_below")) / (p * n)).alias("auc"))


def roc(df: DataFrame, group: Sequence[str], label: str, score: str) -> DataFrame:
    """``score, tpr, fpr`` at each distinct score taken as a threshold."""
    down = Window.partitionBy(*group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    c = score_counts(df, group, label, score)
    total = c.groupBy(*group).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    c = c.withColumns({"_tp": F.sum("pos").over(down), "_fp": F.sum("neg").over(down)})
    c = c.join(total, list(group)) if group else c.join(F.broadcast(total))
    c = c.where("_p > 0 and _n > 0")
    return c.select(*group, "score", (F.col("_tp") / F.col("_p")).alias("tpr"), (F.col("_fp") / F.col("_n")).alias("fpr"))


def youden(df: DataFrame, group: Sequence[str], label: str, score: str) -> DataFrame:
    """The threshold with the largest tpr - fpr, the highest of equal ones, and that difference as ``j``."""
    r = roc(df, group, label, score).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 12))
    best = F.max(F.struct("j", "score"))
    return r.groupBy(*group).agg(best.alias("b")).select(*group, F.col("b.score").alias("threshold"), F.col("b.j").alias("j"))
