"""Permutation p-values, false discovery rates, rank sums."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidepool.functions.quantiles import chi2_sf, normal_two_sided, t_quantile
from tidepool.operators.models import dealt
from tidepool.operators.series import mid_ranks


def permutation_p(null: DataFrame, observed: DataFrame, group: Sequence[str], stat: str, strict: bool = True) -> DataFrame:
    """``observed`` with ``p``: (k + 1) / (n + 1), k null values above (or at least at) the observed one."""
    o = observed.select(*group, F.col(stat).alias("_o"))
    hit = F.col(stat) > F.col("_o") if strict else F.col(stat) >= F.col("_o")
    found = null.join(o, list(group)).groupBy(*group).agg(F.count_if(hit).alias("_k"), F.count(stat).alias("_n"))
    p = (F.coalesce("_k", F.lit(0)) + 1) / (F.coalesce("_n", F.lit(0)) + 1)
    return observed.join(found, list(group), "left").withColumn("p", p).drop("_k", "_n")


def permutation_p_among(df: DataFrame, group: Sequence[str], stats: Sequence[str], strict: bool = True, permutation: str = "permutation") -> DataFrame:
    """Each group's ``stats`` of permutation 0, with ``p`` (several: ``p_<stat>``) as ``permutation_p`` has it against its other permutations.

    Model and null values come from one table, so what makes them runs once; a group has a row for each permutation.
    """
    own = Window.partitionBy(*group)
    null = F.col(permutation) > 0
    marked = df.withColumns({f"_o_{s}": F.max(F.when(~null, F.col(s))).over(own) for s in stats})
    parts = []
    for s in stats:
        hit = (F.col(s) > F.col(f"_o_{s}")) if strict else (F.col(s) >= F.col(f"_o_{s}"))
        p = (F.count_if(null & hit) + 1) / (F.count(F.when(null, F.col(s))) + 1)
        parts += [F.first(f"_o_{s}").alias(s), p.alias("p" if len(stats) == 1 else f"p_{s}")]
    return marked.groupBy(*group).agg(*parts)


#: Ranges that p-values without groups are ranked in.
RANGES = 64


def _ranked(df: DataFrame, group: Sequence[str], p: str) -> tuple[DataFrame, list[str]]:
    """Distinct p-values with ``_i`` (how many of the group are as low) and ``_v`` (their number), and what keeps tasks apart.

    Without groups, values are dealt into ranges between approximate percentiles, and counts of lower ranges are added, so no task ranks
    all of them.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(*group, p).agg(F.count(F.lit(1)).alias("_k"))
    by = list(group)
    if not group:
        cuts = counts.agg(F.percentile_approx(p, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(1000)).alias("_cuts"))
        counts = counts.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(p)))).drop("_cuts")
        by = ["_range"]
    inside = F.sum("_k").over(Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    if group:
        total = counts.groupBy(*group).agg(F.sum("_k").alias("_v"))
        return counts.join(total, by).withColumn("_i", inside).drop("_k"), by
    parts = counts.groupBy("_range").agg(F.sum("_k").alias("_s"))  # a row for each range
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_range", before.alias("_before"), F.sum("_s").over(Window.partitionBy(F.lit(0))).alias("_v"))
    return counts.join(F.broadcast(parts), "_range").withColumn("_i", F.col("_before") + inside).drop("_k", "_before"), by


def _dependence(v: Column, dependent: bool) -> Column:
    """1, or the sum of 1 / i up to v."""
    return F.aggregate(F.sequence(F.lit(1), v.cast("int")), F.lit(0.0), lambda a, i: a + 1 / i) if dependent else F.lit(1.0)


def fdr_threshold(df: DataFrame, group: Sequence[str], p: str, q: float, dependent: bool = False) -> DataFrame:
    """``threshold``: the largest p at or below its rank / number x q (over the harmonic sum, if dependent); null if none."""
    rows = _ranked(df, group, p)[0].withColumn("_c", _dependence(F.col("_v"), dependent))
    return rows.groupBy(*group).agg(F.max(F.when(F.col(p) <= F.col("_i") / F.col("_v") * q / F.col("_c"), F.col(p))).alias("threshold"))


def fdr_adjusted(df: DataFrame, group: Sequence[str], p: str, dependent: bool = False) -> DataFrame:
    """Rows with ``corrected`` (p x number x c / rank, equal values having the last one's rank) and ``adjusted`` (its running minimum from the largest p, 1 at most)."""
    rows, by = _ranked(df, group, p)
    rows = rows.withColumn("corrected", F.col(p) * F.col("_v") * _dependence(F.col("_v"), dependent) / F.col("_i"))
    adjusted = F.min("corrected").over(Window.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    if not group:
        after = F.min("_m").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))
        least = rows.groupBy("_range").agg(F.min("corrected").alias("_m")).select("_range", after.alias("_after"))
        rows = rows.join(F.broadcast(least), "_range")
        adjusted = F.least(adjusted, F.col("_after"))
    values = rows.select(*group, p, "corrected", F.least(F.lit(1.0), adjusted).alias("adjusted"))
    return df.join(values, [*group, p])


def fdr_grid(df: DataFrame, group: Sequence[str], p: str, points: int = 1000, high: float = 0.1, low: float = 1e-6) -> DataFrame:
    """Rows with ``q``: the smallest point of a logarithmic grid at which they pass, 1 if none.

    A row passes at a point from its adjusted p on, so the point follows from it by a logarithm.
    """
    rows = fdr_adjusted(df, group, p)
    step = (_log10(high) - _log10(low)) / (points - 1)
    at = F.ceil((F.log10(F.greatest("adjusted", F.lit(low))) - _log10(low)) / step - 1e-9)
    q = F.when(F.col("adjusted") <= high * (1 + 1e-12), F.pow(F.lit(10.0), _log10(low) + at * step)).otherwise(1.0)
    return rows.withColumn("q", q).drop("corrected", "adjusted")


def _log10(x: float) -> float:
    import math

    return math.log10(x)


def rank_sum(df: DataFrame, group: Sequence[str], value: str, label: str) -> DataFrame:
    """``n1, n0, w, z`` of the two labels (1 and 0): rank sum of label 1, and its tie- and continuity-corrected normal score."""
    ok = df.where(F.col(value).isNotNull() & F.col(label).isin(0, 1))
    ranked = mid_ranks(ok, group, value, "_r")
    ties = ok.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_k")).groupBy(*group).agg(F.sum(F.col("_k") * F.col("_k") * F.col("_k") - F.col("_k")).alias("_t"))
    found = ranked.groupBy(*group).agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"), F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("w"))
    found = found.join(ties, list(group)) if group else found.join(F.broadcast(ties))
    n = F.col("n1") + F.col("n0")
    mean = F.col("n1") * (n + 1) / 2
    spread = F.sqrt(F.col("n1") * F.col("n0") / 12 * (n + 1 - F.col("_t") / (n * (n - 1))))
    d = F.col("w") - mean
    return found.where("n1 > 0 and n0 > 0").select(*group, "n1", "n0", "w", F.when(spread > 0, (d - 0.5 * F.signum(d)) / spread).alias("z"))


def _each(f, *columns: pd.Series) -> pd.Series:
    """``f`` of each distinct combination of values, computed once in a batch; null where any is."""
    rows = pd.concat(columns, axis=1, keys=range(len(columns)))
    known = rows.dropna().drop_duplicates()
    made = known.assign(value=[f(*v) for v in known.itertuples(index=False)])
    return rows.merge(made, "left")["value"].astype(float)


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return _each(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _each(chi2_sf, x, dof)


def t_quantiles(p: float):
    """The ``p`` quantile of the t distribution with so many degrees of freedom, as a function of a column."""

    @F.pandas_udf(DoubleType())
    def found(dof: pd.Series) -> pd.Series:
        return _each(lambda d: t_quantile(p, d), dof)

    return found


#: Shuffles of a group that one task makes, and numbers that it draws at once.
SHUFFLES = 1000
DRAWN = 1 << 20


def surrogate_differences(df: DataFrame, group: Sequence[str], a: str, b: str, shuffles: int, size: int, seed: int = 0) -> DataFrame:
    """``shuffle, i, diff``: ``size`` values of ``a`` minus ``size`` of ``b``, each a random subset in order, for every shuffle.

    Randomness follows from the seed, the group and the batch of ``SHUFFLES`` that a task makes of it, wherever it runs; a batch's shuffles are drawn
    together, the values with the least of as many random numbers.
    """
    import numpy as np

    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        batch = int(rows["_batch"].iloc[0])
        keys = {g: rows[g].iloc[0] for g in group}
        rng = np.random.default_rng([seed, batch, *"|".join(map(str, keys.values())).encode()])
        values = [np.sort(rows[c].dropna().to_numpy()) for c in (a, b)]
        n, numbers = min(size, *map(len, values)), np.arange(batch * SHUFFLES, min((batch + 1) * SHUFFLES, shuffles))

        def drawn(v: np.ndarray) -> np.ndarray:
            made, some = np.empty((len(numbers), n)), max(DRAWN // max(len(v), 1), 1)
            for lo in range(0, len(numbers), some):
                at = rng.random((len(numbers[lo : lo + some]), len(v)))
                at = np.argpartition(at, n - 1, axis=1)[:, :n] if n else np.zeros((len(at), 0), int)
                made[lo : lo + some] = v[np.sort(at, axis=1)]
            return made

        diff = drawn(values[0]) - drawn(values[1])
        return pd.DataFrame({**keys, "shuffle": np.repeat(numbers, n), "i": np.tile(np.arange(n), len(numbers)), "diff": diff.ravel()})

    rows = df.select(*group, a, b).where(F.col(a).isNotNull() | F.col(b).isNotNull())
    rows = rows.withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit((shuffles - 1) // SHUFFLES))))
    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "shuffle int, i long, diff double"])
    return dealt(rows, *group, "_batch").groupBy(*group, "_batch").applyInPandas(run, schema)
