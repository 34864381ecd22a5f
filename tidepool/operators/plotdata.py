"""The numbers that the reference figures draw, as tables; nothing is rendered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import agg


def box(df: DataFrame, group: Sequence[str], value: str, approx: bool = False) -> DataFrame:
    """``n, mean, sd, sem_low, sem_high, q1, median, q3`` of each group."""
    e = agg.sem(value) * 1.96
    moments = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.avg(value) - e).alias("sem_low"), (F.avg(value) + e).alias("sem_high"))
    return agg.joined(moments, agg.percentiles(df, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, approx), group)


def spread_points(df: DataFrame, group: Sequence[str], order: str, value: str, bins: int = 10, width: float = 0.5) -> DataFrame:
    """Points with ``offset``: those in one bin of values lie beside each other, evenly about the middle."""
    rows = agg.with_stats(df.where(F.col(value).isNotNull()), group, _a=F.min(value), _b=F.max(value))
    size = (F.col("_b") - F.col("_a")) / bins
    rows = rows.withColumn("bin", F.when(size > 0, F.least(F.floor((F.col(value) - F.col("_a")) / size), F.lit(bins - 1))).otherwise(0).cast("int"))
    by = Window.partitionBy(*group, "bin")
    rows = rows.withColumns({"_k": F.row_number().over(by.orderBy(value, order)), "_n": F.count(F.lit(1)).over(by)})
    rows = agg.with_stats(rows, group, _most=F.max("_n"))
    return rows.withColumn("offset", width * (F.col("_k") - (F.col("_n") + 1) / 2) / F.col("_most")).drop("_a", "_b", "_k", "_n", "_most")


def violin(df: DataFrame, group: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, center, n, width``: a histogram as wide as its fullest bin."""
    h = agg.histogram(df, group, value, low, high, bins)
    return agg.max_normalised(h, group, "n", "width").drop("share")


def violins(df: DataFrame, group: Sequence[str], value: str, kind: str = "even", bins: int = 10, points: int = 100) -> DataFrame:
    """``point, center, n, step``: each group's outline over its own range; ``violin_widths`` makes widths of it. Empty bins aren't listed.

    ``even``: ``bins`` equal bins. ``auto``: as many bins as ``agg.auto_bins`` chooses, or one for each value of a discrete group.
    ``kernel``: a normal kernel of the reference width (from the median absolute deviation; of the standard deviation where that is 0) at
    ``points`` points to three widths beyond the range. ``bin_kernel``: one two thirds as wide as an automatic bin, at thirds of it to one bin beyond.
    The kernels' heights sum to the group's number of values. Equal values are counted before kernels are laid over them.
    """
    known = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    counts = known.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    stats = known.groupBy(*group).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_sd"))
    size = F.col("_b") - F.col("_a")
    if kind == "even":
        stats = stats.withColumns({"discrete": F.lit(False), "bins": F.lit(bins).cast("long")})
    elif kind in ("auto", "bin_kernel"):
        chosen = agg.auto_bins(known, group, "_v").select(*group, "discrete", F.greatest("bins", F.lit(1)).cast("long").alias("bins"))
        stats = agg.joined(stats, chosen, group)
    elif kind != "kernel":
        raise ValueError(f"no such kind: {kind}")
    if kind in ("even", "auto"):
        rows = agg.joined_in_parts(counts, stats, group, "_v").withColumn("step", F.when(size > 0, size / F.col("bins")).otherwise(1.0))
        at = F.least(F.floor((F.col("_v") - F.col("_a")) / F.col("step")), F.col("bins") - 1).cast("int")
        middle = F.when(size > 0, F.col("_a") + (at + 0.5) * F.col("step")).otherwise(F.col("_v"))
        binned = rows.where(~F.col("discrete")).select(*group, at.alias("point"), middle.alias("center"), "step", "_c")
        found = binned.groupBy(*group, "point", "center", "step").agg(F.sum("_c").cast("double").alias("n")).select(*group, "point", "center", "n", "step")
        if kind == "even":
            return found
        near = Window.partitionBy(*group).orderBy("_v")
        values = rows.where("discrete").withColumns({"point": (F.row_number().over(near) - 1).cast("int"), "_gap": F.col("_v") - F.lag("_v").over(near)})
        values = values.withColumn("step", F.coalesce(F.min("_gap").over(Window.partitionBy(*group)), F.lit(1.0)))
        return found.unionByName(values.select(*group, "point", F.col("_v").alias("center"), F.col("_c").cast("double").alias("n"), "step"))
    if kind == "kernel":
        middle = agg.percentiles(counts, group, "_v", {"_m": 0.5}, rounds=0, weight="_c")
        off = agg.joined_in_parts(counts, middle, group, "_v").select(*group, F.abs(F.col("_v") - F.col("_m")).alias("_off"), "_c")
        stats = agg.joined(stats, agg.percentiles(off, group, "_off", {"_mad": 0.5}, rounds=0, weight="_c"), group)
        sd = F.when(F.col("_mad") > 0, F.col("_mad") / 0.6745).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
        stats = stats.withColumn("_w", sd * F.pow(4 / (3 * F.col("_n")), F.lit(0.2)))
        first, last, steps = F.col("_a") - 3 * F.col("_w"), F.col("_b") + 3 * F.col("_w"), F.lit(points - 1)
        stats = stats.withColumns({"step": (last - first) / steps, "_first": first, "_steps": steps})
    else:
        bin_size = F.when(size > 0, size / F.col("bins")).otherwise(0.1)
        stats = stats.withColumns({"step": bin_size / 3, "_w": bin_size / 1.5, "_first": F.col("_a") - bin_size, "_steps": (3 * F.when(size > 0, F.col("bins")).otherwise(0) + 6).cast("int")})
    laid = agg.joined_in_parts(counts, stats, group, "_v").withColumn("point", F.explode(F.sequence(F.lit(0), F.col("_steps").cast("int"))))
    center = F.col("_first") + F.col("point") * F.col("step")
    z = (center - F.col("_v")) / F.col("_w")
    own = [F.first(c).alias(c) for c in ("_first", "step", "_n")]  # the same in all of a group's rows
    heights = laid.groupBy(*group, "point").agg(F.sum(F.col("_c") * F.exp(-z * z / 2)).alias("_h"), *own)
    share = F.col("_h") / F.sum("_h").over(Window.partitionBy(*group))
    return heights.select(*group, "point", center.alias("center"), (share * F.col("_n")).alias("n"), "step")


def violin_widths(rows: DataFrame, group: Sequence[str], norms: Mapping[str, int]) -> DataFrame:
    """Rows of ``violins`` with a column of widths, at most 1, for each of ``norms`` (name: norm).

    Norm 0: every group's widest point has 1; 1: widths follow counts over all groups; 2: areas follow the groups' counts; 3: all areas are
    equal. The widest group of 1, 2 and 3 has 1.
    """
    units = (F.col("_most"), F.lit(1.0), F.col("step"), F.col("step") * F.col("_all"))
    known = rows.groupBy(*group).agg(F.max("n").alias("_most"), F.sum("n").alias("_all"), F.first("step").alias("_step"))
    own = (F.col("_most"), F.lit(1.0), F.col("_step"), F.col("_step") * F.col("_all"))
    tops = known.agg(*[F.max(F.col("_most") / own[k]).alias(f"_top_{name}") for name, k in norms.items()])
    wide = agg.joined(agg.joined(rows, known.drop("_step"), group), tops, [])
    wide = wide.withColumns({name: F.col("n") / units[k] / F.col(f"_top_{name}") for name, k in norms.items()})
    return wide.drop("_most", "_all", *[f"_top_{name}" for name in norms])


def swarm(null: DataFrame, observed: DataFrame, group: Sequence[str], stat: str) -> DataFrame:
    """Null values and the model's own, marked ``is_model``."""
    return null.select(*group, stat, F.lit(False).alias("is_model")).unionByName(observed.select(*group, stat, F.lit(True).alias("is_model")))


def swarm_among(df: DataFrame, group: Sequence[str], stat: str, permutation: str = "permutation") -> DataFrame:
    """As ``swarm`` of one table, permutation 0 being the model, so what makes it runs once."""
    return df.select(*group, stat, (F.col(permutation) == 0).alias("is_model"))


def heatmap(coefs: DataFrame, group: Sequence[str], name: str = "name", value: str = "coefficient") -> DataFrame:
    """Mean absolute coefficients, scaled to -1 .. 1 in each group."""
    means = coefs.groupBy(*group, name).agg(F.avg(F.abs(value)).alias("mean_abs"))
    return agg.min_max_scaled(means, group, "mean_abs", "scaled")
