"""Whole analyses over long tables: a row's group says whose data it is, so all groups run in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.columns import result_text
from tidepool.functions.features import SIDES, feature_sets
from tidepool.operators import agg, inference, models, statespace


def _subsets(df: DataFrame, subject: str, order: str, features: str, y: str, subsets: Mapping[str, Sequence[int]]) -> DataFrame:
    """Rows once for each subset of the feature array, which is ``x``."""
    picked = [F.struct(F.lit(n).alias("subset"), F.array(*[F.get(features, F.lit(i)) for i in at]).alias("x")) for n, at in subsets.items()]
    return df.withColumn("_s", F.explode(F.array(*picked))).select(subject, "_s.subset", order, "_s.x", y)


def grid(df: DataFrame, subject: str, order: str, features: str, y: str, subsets: Mapping[str, Sequence[int]], model: str = "lda", permutations: int = 20, folds: int = 0, gap: int = 0) -> DataFrame:
    """``subject, subset, auc, p``: a cross-validated classifier for each subject and subset of the feature array, against permutations."""
    rows = agg.median_split(_subsets(df, subject, order, features, y, subsets), [subject, "subset"], y, "label")
    areas = models.statistics(rows, [subject, "subset"], "x", "label", order, model, "auc", folds, gap, permutations)
    return inference.permutation_p_among(areas, [subject, "subset"], ["auc"])


def regression_grid(df: DataFrame, subject: str, order: str, features: str, y: str, subsets: Mapping[str, Sequence[int]], model: str = "lasso", permutations: int = 20, folds: int = 0, gap: int = 0) -> DataFrame:
    """``subject, subset, r2, rho, rmse, p_r2, p_rho``: a cross-validated regression for each subject and subset of the feature array; R2 and correlation against permutations."""
    keys = [subject, "subset"]
    found = models.statistics(_subsets(df, subject, order, features, y, subsets), keys, "x", y, order, model, "regression", folds, gap, permutations)
    out = inference.permutation_p_among(found, keys, ["r2", "rho", "rmse"])
    return out.select(*keys, "r2", "rho", "rmse", "p_r2", "p_rho")


def region_grid(df: DataFrame, subject: str, order: str, features: str, names: Sequence[str], y: str, one_sided: Column, model: str = "lda", permutations: int = 20, folds: int = 0) -> DataFrame:
    """``subject, subset, auc, p, result`` over the sets of sides and regions: nine for two-sided subjects, three for those that ``one_sided`` is true of."""

    def subsets(sides: tuple[str, ...]) -> dict[str, list[int]]:
        known = [n for n in names if n.startswith(sides)]
        return {s.name: [names.index(c) for c in s.columns(known)] for s in feature_sets(sides)}

    parts = [(df.where(~one_sided), subsets(SIDES)), (df.where(one_sided), subsets(SIDES[1:]))]
    both = [grid(rows, subject, order, features, y, sets, model, permutations, folds) for rows, sets in parts]
    return both[0].unionByName(both[1]).withColumn("result", result_text("auc", "p"))


def optimal_metrics(df: DataFrame, group: Sequence[str], truth: str, score: str) -> DataFrame:
    """``threshold`` (Youden's), ``tp, fp, tn, fn``, and sensitivity, specificity, ppv and accuracy with exact limits (``_low``, ``_high``), all to 3 digits."""
    best = agg.youden(df, group, truth, score).select(*group, "threshold")
    known = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).join(best, list(group))
    c = agg.confusion(known.withColumn("_over", F.col(score) - F.col("threshold")), [*group, "threshold"], truth, "_over", 0.0)
    hits = {"sensitivity": ("tp", "fn"), "specificity": ("tn", "fp"), "ppv": ("tp", "fp")}
    shares = {n: (F.col(a), F.col(a) + F.col(b)) for n, (a, b) in hits.items()}
    shares["accuracy"] = (F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    c = c.withColumns({f"_{n}": models.share_limits(k, of) for n, (k, of) in shares.items()})
    rates = [x for n in shares for x in (F.round(n, 3).alias(n), F.col(f"_{n}.low").alias(f"{n}_low"), F.col(f"_{n}.high").alias(f"{n}_high"))]
    return c.select(*group, F.round("threshold", 3).alias("threshold"), "tp", "fp", "tn", "fn", *rates)


def state_decoding(df: DataFrame, subject: str, recording: str, order: str, x: str, score: DataFrame, y: str, horizon: int = 10, orders: Sequence[int] = range(1, 21), permutations: int = 20, gap: int = 4) -> DataFrame:
    """``subject, auc, p``: labels of recordings decoded from the last state of each by a model of the subject's whole series.

    Models are fitted once: the median that splits a subject's scores is a window over its recordings, which are one matrix afterwards, and not a statistic that is joined
    back to what it was made of.
    """
    last = statespace.recording_states(df, [subject], recording, order, x, horizon, orders).join(score, [subject, recording])
    rows = last.withColumn("label", (F.col(y) >= F.percentile(y, F.lit(0.5)).over(Window.partitionBy(subject))).cast("int"))
    areas = models.statistics(rows, [subject], "state", "label", recording, "lda_uniform", "auc", 0, gap, permutations)
    return inference.permutation_p_among(areas, [subject], ["auc"], strict=False)
