"""Cross-validated models: one task for each group and some permutations, which share its matrix."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tidepool.functions import linmod
from tidepool.functions.quantiles import clopper_pearson

#: Permutations that one task makes, so a group's matrix goes to the tasks once for so many: of models that are fitted one by one, and of those that are solved together.
BATCH = 20
STACKED_BATCH = 200
#: Rows of a group up to which discriminants make ``FEW_ROWS_BATCH`` permutations in a task, as what goes to and from it would take longer than they do.
FEW_ROWS, FEW_ROWS_BATCH = 32, 1000
LASSO_ALPHA = 1e-4
#: Rows of a group in one task of ``left_out``; of larger groups tasks add up moments first.
GROUP_ROWS = 20_000

Fit = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]]


def _linear(fit) -> Fit:
    def made(x: np.ndarray, y: np.ndarray):
        w, b = fit(x, y)
        return lambda z: z @ w + b

    return made


def _probability(fit) -> Fit:
    def made(x: np.ndarray, y: np.ndarray):
        w, b = fit(x, y)
        return lambda z: 1 / (1 + np.exp(-np.clip(z @ w + b, -700, 700)))

    return made


def _machine(x: np.ndarray, y: np.ndarray):
    m, sd = x.mean(0), np.where(x.std(0) == 0, 1, x.std(0))
    rows, a, b = linmod.rbf_svm((x - m) / sd, y, 1.0, np.sqrt(x.shape[1]))
    return lambda z: 1 / (1 + np.exp(-(np.exp(-((((z - m) / sd)[:, None] - rows[None]) ** 2).sum(-1) / x.shape[1]) @ a + b)))


def _searched(x: np.ndarray, y: np.ndarray):
    m, sd = x.mean(0), np.where(x.std(0) == 0, 1, x.std(0))
    rows, a, b, _, scale = linmod.searched_machine((x - m) / sd, y)
    return lambda z: 1 / (1 + np.exp(-np.clip(np.exp(-((((z - m) / sd)[:, None] - rows[None]) ** 2).sum(-1) / scale**2) @ a + b, -700, 700)))


MODELS: dict[str, Fit] = {
    "lda": _probability(lambda x, y: linmod.lda(x, y, "auto")),
    "lda_full": _probability(lambda x, y: linmod.lda(x, y, 1.0)),
    "lda_uniform": _probability(lambda x, y: linmod.lda(x, y, "auto", (0.5, 0.5), "diagonal")),
    "lasso": _linear(lambda x, y: linmod.lasso(x, y, LASSO_ALPHA)),
    "ridge": _linear(lambda x, y: linmod.ridge(x, y, linmod.ridge_penalty(x, y))),
    "logistic": _probability(linmod.logistic),
    "svm": _machine,
    "svm_searched": _searched,
}


def _matrix(rows: pd.DataFrame, x: str, y: str, order: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    rows = rows.sort_values(order)
    return rows, np.stack(rows[x].to_numpy()).astype(float), rows[y].to_numpy(float)


def _standardised(x: np.ndarray, like: np.ndarray | None = None) -> np.ndarray:
    like = x if like is None else like
    sd = like.std(0)
    return (x - like.mean(0)) / np.where(sd == 0, 1, sd)


def _out_of_fold(x: np.ndarray, y: np.ndarray, fit: Fit, folds: list[np.ndarray], gap: int, scaling: str) -> np.ndarray:
    out = np.full(len(y), np.nan)
    z = _standardised(x) if scaling == "global" else x
    for test in folds:
        train = np.ones(len(y), bool)
        train[max(test[0] - gap, 0) : test[-1] + gap + 1] = False
        if train.sum() < 3 or len(np.unique(y[train])) < 2:
            continue
        a, b = (z[train], z[test]) if scaling == "global" else (_standardised(x[train]), _standardised(x[test], x[train]))
        out[test] = fit(a, y[train])(b)
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` into tasks that Spark doesn't merge again: it would by their few bytes, but each group is much work."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys) if keys else df


def _batched(df: DataFrame, permutations: int, size: int = BATCH) -> DataFrame:
    """Rows once for each batch of permutations."""
    return df.withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit(max(permutations - 1, 0) // size))))


def _batched_by_rows(df: DataFrame, group: Sequence[str], permutations: int, model: str) -> DataFrame:
    """``_batched``, with fewer and larger batches for groups of few rows (see ``_batch_size``)."""
    many = max(permutations - 1, 0)
    size, larger = (many // _batch_size(model, rows) for rows in (FEW_ROWS + 1, FEW_ROWS))
    if size == larger or not group:
        return _batched(df, permutations, _batch_size(model))
    last = F.when(F.count(F.lit(1)).over(Window.partitionBy(*group)) <= FEW_ROWS, larger).otherwise(size)
    return df.withColumn("_last", last).withColumn("_batch", F.explode(F.sequence(F.lit(0), "_last"))).drop("_last")


def _numbers(batch: int, permutations: int, size: int) -> np.ndarray:
    """A batch's permutations: ``size`` of them, and the first batch has number 0 too, so it has no batch of its own at the end."""
    return np.arange(batch * size + (batch > 0), min((batch + 1) * size, permutations) + 1)


#: Discriminants that are solved for all folds and permutations together: priors and what the covariance shrinks to.
DISCRIMINANTS: dict[str, tuple[tuple[float, float] | None, str]] = {"lda": (None, "identity"), "lda_uniform": ((0.5, 0.5), "diagonal")}


def _trained(n: int, folds: list[np.ndarray], gap: int) -> np.ndarray:
    """``folds x rows``: which rows each fold's model is fitted on."""
    out = np.ones((len(folds), n), bool)
    for rows, test in zip(out, folds, strict=True):
        rows[max(test[0] - gap, 0) : test[-1] + gap + 1] = False
    return out


def _stacked_discriminants(x: np.ndarray, truths: np.ndarray, folds: list[np.ndarray], gap: int, priors, target: str) -> np.ndarray:
    """Out-of-fold probabilities, ``permutations x rows``; standardised by all rows or by a fold's, these discriminants are the same."""
    z, trained = _standardised(x), _trained(len(x), folds, gap)
    out = np.full(truths.shape, np.nan)
    w, b, fitted = linmod.folded_lda(z, truths == 1, trained, priors, target)
    if len(folds) == len(x):
        odds = np.einsum("ijk,jk->ij", w, z) + b
        return np.where(fitted, 1 / (1 + np.exp(-np.clip(odds, -700, 700))), np.nan)
    for f, test in enumerate(folds):
        odds = w[:, f] @ z[test].T + b[:, f, None]
        out[:, test] = np.where(fitted[:, f, None], 1 / (1 + np.exp(-np.clip(odds, -700, 700))), np.nan)
    return out


def _stacked_lassos(x: np.ndarray, truths: np.ndarray, folds: list[np.ndarray], gap: int, scaling: str) -> np.ndarray:
    """Out-of-fold predictions, ``permutations x rows``: a fold's products of features are formed once for all permutations, and products with the labels once for all folds, less a fold's own rows."""
    trained, out = _trained(len(x), folds, gap), np.full(truths.shape, np.nan)
    means = truths.mean(1)
    z, y = _standardised(x), truths.T - means
    whole = z.T @ y
    kept = [f for f, train in enumerate(trained) if train.sum() >= 3]
    for lo in range(0, len(kept), 64):
        some, grams, products, centered = kept[lo : lo + 64], [], [], []
        for f in some:
            train, left = trained[f], ~trained[f]
            own = z if scaling == "global" else _standardised(x, x[train])
            center, mean = own[train].mean(0), -y[left].sum(0) / train.sum()
            own = own - center
            grams.append(own[train].T @ own[train])
            products.append(whole - z[left].T @ y[left] - np.outer(center * train.sum(), mean) if scaling == "global" else own[train].T @ y[train])
            centered.append((own[folds[f]], means + mean))
        w = linmod.stacked_lasso(np.array(grams), np.array(products), trained[some].sum(1), LASSO_ALPHA)
        for i, f in enumerate(some):
            test, mean = centered[i]
            out[:, folds[f]] = np.where(np.ptp(truths[:, trained[f]], axis=1)[:, None] > 0, mean[:, None] + (test @ w[i]).T, np.nan)
    return out


@functools.lru_cache(maxsize=16)
def _orders(seed: int, first: int, end: int, n: int) -> np.ndarray:
    """Permutations ``first .. end`` of ``n`` rows, which groups of a size share; number 0 leaves them in order."""
    return np.array([np.random.default_rng([seed, perm]).permutation(n) if perm else np.arange(n) for perm in range(first, end)]).reshape(end - first, n)


def _permuted(model: str, m: np.ndarray, truth: np.ndarray, batch: int, permutations: int, folds: int, gap: int, seed: int, scaling: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The permutations of a batch of ``size``, and of each its labels and out-of-fold scores."""
    parts = [p for p in np.array_split(np.arange(len(truth)), folds or len(truth)) if len(p)]
    perms = _numbers(batch, permutations, size)
    truths = truth[_orders(seed, perms[0], perms[-1] + 1, len(truth))]
    if model in DISCRIMINANTS:
        return perms, truths, _stacked_discriminants(m, truths, parts, gap, *DISCRIMINANTS[model])
    if model == "lasso":
        return perms, truths, _stacked_lassos(m, truths, parts, gap, scaling)
    return perms, truths, np.array([_out_of_fold(m, t, MODELS[model], parts, gap, scaling) for t in truths]).reshape(truths.shape)


def _batch_size(model: str, rows: int | None = None) -> int:
    """Permutations that a task makes of a group, of ``rows`` if known."""
    if rows is not None and rows <= FEW_ROWS and model in DISCRIMINANTS:
        return FEW_ROWS_BATCH
    return STACKED_BATCH if model in DISCRIMINANTS or model == "lasso" else BATCH


def cross_validated(
    df: DataFrame, group: Sequence[str], x: str, y: str, order: str, model: str = "lda", folds: int = 0, gap: int = 0, permutations: int = 0, seed: int = 0, scaling: str = "global"
) -> DataFrame:
    """``permutation, order, truth, score`` of out-of-fold predictions; ``folds`` 0: leave one out. Permutation 0 keeps the labels.

    A group's rows are a small matrix (a participant's recordings); for larger ones see ``left_out``. A task makes a batch of permutations of it; their random numbers follow
    from the seed and the permutation's number. Shrunk discriminants and Lasso are solved for all folds and permutations of a task together, from products that
    are formed once; the other models are fitted one by one.
    """
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        batch = int(rows["_batch"].iloc[0])
        rows, m, truth = _matrix(rows, x, y, order)
        perms, truths, scores = _permuted(model, m, truth, batch, permutations, folds, gap, seed, scaling, _batch_size(model))
        keys = {g: np.tile(rows[g].to_numpy(), len(perms)) for g in group}
        return pd.DataFrame({**keys, "permutation": np.repeat(perms, len(truth)), order: np.tile(rows[order].to_numpy(), len(perms)), "truth": truths.ravel(), "score": scores.ravel()})

    ok = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*group, order, x, y)
    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], f"permutation int, {order} {kinds[order]}, truth double, score double"])
    out = dealt(_batched(ok, permutations, _batch_size(model)), *group, "_batch").groupBy(*group, "_batch").applyInPandas(run, schema)
    return out.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def _area(truth: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    return (linmod.areas(truth, score),)


def _quality(truth: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """R2, root mean squared error and correlation along the last axis; those that aren't defined are NaN."""
    if not truth.shape[-1]:
        return (np.full(truth.shape[:-1], np.nan),) * 3
    sse, spread, other = ((truth - score) ** 2).sum(-1), truth - truth.mean(-1, keepdims=True), score - score.mean(-1, keepdims=True)
    sst, sss = (spread**2).sum(-1), (other**2).sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2, rho = 1 - sse / sst, (spread * other).sum(-1) / np.sqrt(sst * sss)
    return np.where(sst > 0, r2, np.nan), np.sqrt(sse / truth.shape[-1]), np.where((sst > 0) & (sss > 0), rho, np.nan)


STATISTICS = {"auc": (("auc",), _area), "regression": (("r2", "rmse", "rho"), _quality)}


def _measured(truths: np.ndarray, scores: np.ndarray, kind: str) -> np.ndarray:
    """``statistics x permutations``, over the rows of each that have a score: at once where these are the same ones."""
    names, measure = STATISTICS[kind]
    if kind == "auc":
        return np.array(measure(truths, scores))
    out, known = np.full((len(names), len(truths)), np.nan), ~np.isnan(scores)
    whole = known.all(1)
    out[:, whole] = measure(truths[whole], scores[whole])
    for i in np.nonzero(~whole)[0]:
        out[:, [i]] = measure(truths[i, known[i]][None], scores[i, known[i]][None])
    return out


def statistics(
    df: DataFrame, group: Sequence[str], x: str, y: str, order: str, model: str = "lda", kind: str = "auc", folds: int = 0, gap: int = 0, permutations: int = 0, seed: int = 0, scaling: str = "global"
) -> DataFrame:
    """``permutation`` and the area (``auc``) or ``r2, rmse, rho`` (``regression``) of ``cross_validated`` predictions; permutation 0 is the model.

    A permutation's predictions stay in the task that makes them; a row for each permutation leaves it. Statistics that aren't defined are null.
    """
    kinds, names = dict(df.dtypes), STATISTICS[kind][0]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        batch = int(rows["_batch"].iloc[0])
        rows, m, truth = _matrix(rows, x, y, order)
        perms, truths, scores = _permuted(model, m, truth, batch, permutations, folds, gap, seed, scaling, _batch_size(model, len(rows) if group else None))
        keys = {g: [rows[g].iloc[0]] * len(perms) for g in group}
        return pd.DataFrame({**keys, "permutation": perms, **dict(zip(names, _measured(truths, scores, kind), strict=True))})

    ok = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*group, order, x, y)
    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "permutation int", *[f"{n} double" for n in names]])
    out = dealt(_batched_by_rows(ok, group, permutations, model), *group, "_batch").groupBy(*group, "_batch").applyInPandas(run, schema)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def _with_nulls(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    """Equal keys, nulls included; ``b`` has them under names of its own (``_0, _1, ...``)."""
    return functools.reduce(Column.__and__, [a[n].eqNullSafe(b[f"_{i}"]) for i, n in enumerate(names)], F.lit(True))


def _moments(rows: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """``group, one, center, gram`` of each group's classes: tasks sum their own rows, then sums are added in two steps, so none gets a group's rows."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "one boolean, part long, center array<double>, gram array<double>"])
    names = [*group, "one", "part", "center", "gram"]

    def frame(made: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, part, m.center, m.gram.ravel()) for key, part, m in made], columns=names)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, linmod.Moments] = {}
        part = TaskContext.get().partitionId()
        for rows in frames:
            for key, own in rows.groupby([*group, "one"], dropna=False):
                m = linmod.Moments.of(np.stack(own[x].to_numpy()).astype(float))
                held[key] = linmod.Moments.added([held[key], m]) if key in held else m
            if len(held) > 64:
                yield frame([(k, part, m) for k, m in held.items()])
                held = {}
        yield frame([(k, part, m) for k, m in held.items()])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [linmod.Moments(c, g.reshape((2 * len(c) + 1,) * 2)) for c, g in zip(rows["center"], rows["gram"], strict=True)]
        key = tuple(rows[c].iloc[0] for c in [*group, "one"])
        return frame([(key, rows["part"].iloc[0], linmod.Moments.added(parts))])

    sums = rows.select(*group, "one", x).mapInPandas(partial, schema).withColumn("part", F.pmod("part", F.lit(256)))
    for keys in ([*group, "one", "part"], [*group, "one"]):
        sums = sums.groupBy(*keys).applyInPandas(add, schema)
    return sums.drop("part")


def left_out(df: DataFrame, group: Sequence[str], x: str, y: str, order: str, model: str = "lda", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``permutation (0), order, truth, score`` like ``cross_validated`` that leaves one out, of groups of any size and without fitting anew.

    A shrunk discriminant follows from its classes' counts, sums and products (see ``Moments``); without a row, from these less the
    row's own. Groups of up to ``group_rows`` rows are done in one task each. Of larger ones, moments are summed in the tasks that hold the rows, and go with parts of the group's rows
    to many tasks. Rows without label or vector give none; a row whose class or group has too few others has a null score.
    """
    kinds = dict(df.dtypes)
    priors, target = DISCRIMINANTS[model]
    keys = ", ".join(f"{g} {kinds[g]}" for g in group)
    schema = f"{keys}{', ' if group else ''}permutation int, {order} {kinds[order]}, truth double, score double"

    def score(rows: pd.DataFrame, of: dict[bool, linmod.Moments]) -> pd.DataFrame:
        truth, out = rows[y].to_numpy(float), np.full(len(rows), np.nan)
        if len(of) == 2:
            m = np.stack(rows[x].to_numpy()).astype(float)
            for one in (False, True):
                own = (truth == 1) == one
                odds = linmod.left_out_lda(m[own], of[one], of[not one], one, priors, target)
                out[own] = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        return pd.DataFrame({**{g: rows[g].to_numpy() for g in group}, "permutation": 0, order: rows[order].to_numpy(), "truth": truth, "score": out})

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        m, ones = np.stack(rows[x].to_numpy()).astype(float), rows["one"].to_numpy(bool)
        return score(rows, {one: linmod.Moments.of(m[ones == one]) for one in (False, True) if (ones == one).any()})

    def with_sums(rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        of = {bool(one): linmod.Moments(c, g.reshape((2 * len(c) + 1,) * 2)) for one, c, g in zip(sums["one"], sums["center"], sums["gram"], strict=True)}
        return score(rows, of)

    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*group, order, x, y, (F.col(y) == 1).alias("one"))
    large = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_rows)
    large = large.select(*[F.col(g).alias(f"_{i}") for i, g in enumerate(group)], F.ceil(F.col("_n") / group_rows).alias("_parts"))
    if large.isEmpty():
        return _with_nulls(dealt(rows, *group).groupBy(*group).applyInPandas(alone, schema))
    known = rows.join(large, _same(rows, large, group), "left")
    small = dealt(known.where("_parts is null").select(rows.columns), *group).groupBy(*group).applyInPandas(alone, schema)
    split = known.where("_parts is not null").withColumn("_part", F.pmod(F.xxhash64(order), F.col("_parts"))).select(*rows.columns, "_part")
    sums = _moments(split, group, x)
    sums = sums.join(large, _same(sums, large, group)).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    sums = sums.select(*[F.col(g).alias(f"_{i}") for i, g in enumerate(group)], F.col("_part").alias("_of"), F.col("one"), "center", "gram")
    cogroups = split.groupBy(*group, "_part").cogroup(sums.groupBy(*[f"_{i}" for i in range(len(group))], "_of"))
    return _with_nulls(small.unionByName(cogroups.applyInPandas(with_sums, schema)))


def coefficients(df: DataFrame, group: Sequence[str], x: str, y: str, order: str, names: Sequence[str], model: str = "lda") -> DataFrame:
    """``fold, name, coefficient`` of leave-one-out fits of a linear model on standardised features."""
    kinds = dict(df.dtypes)
    if model not in ("lda", "lasso"):
        raise ValueError(f"no such model: {model}")

    def lassos(z: np.ndarray, t: np.ndarray, folds: list[int]) -> np.ndarray:
        """All folds' coefficients, some folds solved at once."""
        made = []
        for lo in range(0, len(folds), 64):
            grams, products = [], []
            for i in folds[lo : lo + 64]:
                a, b = np.delete(z, i, 0), np.delete(t, i)
                a, b = a - a.mean(0), b - b.mean()
                grams.append(a.T @ a)
                products.append((a.T @ b)[:, None])
            made.append(linmod.stacked_lasso(np.array(grams), np.array(products), np.full(len(grams), len(t) - 1), LASSO_ALPHA)[..., 0])
        return np.concatenate(made)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, m, t = _matrix(rows, x, y, order)
        z, out = _standardised(m), []
        folds = [i for i in range(len(t)) if len(np.unique(np.delete(t, i))) > 1]
        if model == "lasso":
            fitted = lassos(z, t, folds) if folds else []
        else:
            fitted = [linmod.lda(np.delete(z, i, 0), np.delete(t, i), "auto")[0] for i in folds]
        for i, found in zip(folds, fitted, strict=True):
            out += [(i, n, c) for n, c in zip(names, found, strict=True)]
        made = pd.DataFrame(out, columns=["fold", "name", "coefficient"])
        return pd.DataFrame({**{g: [rows[g].iloc[0]] * len(made) for g in group}, **made})

    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "fold int, name string, coefficient double"])
    return dealt(df.where(F.col(y).isNotNull()).select(*group, order, x, y), *group).groupBy(*group).applyInPandas(run, schema)


def linear_shap(coefs: Column, x: Column, means: Column) -> Column:
    """Contributions (x - mean) x coefficient of independent features, as an array."""
    return F.zip_with(F.zip_with(x, means, lambda a, m: a - m), coefs, lambda d, c: d * c)


def _transferred(
    train: DataFrame, test: DataFrame, group: Sequence[str], x: str, y: str, order: str, model: str, permutations: int, seed: int, made: Callable[[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str
) -> DataFrame:
    """What ``made`` has of a group's held rows, a batch's permutations, truths and scores (``permutations x rows``)."""
    kinds = dict(train.dtypes)
    fit = MODELS[model]
    size = STACKED_BATCH if model in DISCRIMINANTS else BATCH

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        batch = int(rows["_batch"].iloc[0])
        _, a, own = _matrix(rows[~rows["is_test"]], x, y, order)
        held, b, truth = _matrix(rows[rows["is_test"]], x, y, order)
        z, there = _standardised(a), _standardised(b, a)
        perms = _numbers(batch, permutations, size)
        labels = own[_orders(seed, perms[0], perms[-1] + 1, len(own))]
        if len(np.unique(own)) < 2:
            scores = np.full((len(perms), len(b)), np.nan)
        elif model in DISCRIMINANTS:
            priors, target = DISCRIMINANTS[model]
            w, c, _ = linmod.folded_lda(z, labels == 1, np.ones((1, len(z)), bool), priors, target)
            scores = 1 / (1 + np.exp(-np.clip(w[:, 0] @ there.T + c, -700, 700)))
        else:
            scores = np.array([fit(z, t)(there) for t in labels]).reshape(len(perms), len(b))
        return made(held, perms, truth, scores)

    both = train.select(*group, order, x, y, F.lit(False).alias("is_test")).unionByName(test.select(*group, order, x, y, F.lit(True).alias("is_test")))
    sides = both.groupBy(*group).agg(F.countDistinct("is_test").alias("_s")).where("_s = 2").select(*group)
    both = both.where(F.col(y).isNotNull()).join(sides, list(group), "left_semi")
    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], schema])
    return dealt(_batched(both, permutations, size), *group, "_batch").groupBy(*group, "_batch").applyInPandas(run, schema)


def transfer(train: DataFrame, test: DataFrame, group: Sequence[str], x: str, y: str, order: str, model: str = "lda", permutations: int = 0, seed: int = 0) -> DataFrame:
    """``permutation, order, truth, score``: fitted on one table, scaled by it, applied to another; permutations shuffle the training labels."""

    def made(held: pd.DataFrame, perms: np.ndarray, truth: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        n = len(perms)
        keys = {g: np.tile(held[g].to_numpy(), n) for g in group}
        return pd.DataFrame({**keys, "permutation": np.repeat(perms, len(held)), order: np.tile(held[order].to_numpy(), n), "truth": np.tile(truth, n), "score": scores.ravel()})

    return _transferred(train, test, group, x, y, order, model, permutations, seed, made, f"permutation int, {order} {dict(train.dtypes)[order]}, truth double, score double")


def transfer_areas(train: DataFrame, test: DataFrame, group: Sequence[str], x: str, y: str, order: str, model: str = "lda", permutations: int = 0, seed: int = 0) -> DataFrame:
    """``permutation, auc`` of ``transfer``, whose scores stay in the task that makes them; null where the other table has one class."""

    def made(held: pd.DataFrame, perms: np.ndarray, truth: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{g: [held[g].iloc[0]] * len(perms) for g in group}, "permutation": perms, "auc": [linmod.auc(truth, s) for s in scores]})

    out = _transferred(train, test, group, x, y, order, model, permutations, seed, made, "permutation int, auc double")
    return out.withColumn("auc", F.when(~F.isnan("auc"), F.col("auc")))


@F.pandas_udf(StructType().add("low", DoubleType()).add("high", DoubleType()))
def share_limits(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Clopper-Pearson limits, rounded to 3 digits; those of each distinct share are computed once in a batch."""
    rows = pd.DataFrame({"k": k, "n": n})
    known = rows.drop_duplicates()
    made = [clopper_pearson(int(a), int(b)) if b else (np.nan, np.nan) for a, b in known.itertuples(index=False)]
    known = known.assign(low=[x[0] for x in made], high=[x[1] for x in made])
    return rows.merge(known, "left")[["low", "high"]].round(3)


def shrinkage(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """``intensity, trace`` of each group's covariance, shrunk to a multiple of the identity."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cov, intensity = linmod.ledoit_wolf(np.stack(rows[x]))
        return pd.DataFrame({**{g: rows[g].iloc[:1] for g in group}, "intensity": intensity, "trace": np.trace(cov)})

    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "intensity double, trace double"])
    return df.where(F.col(x).isNotNull()).select(*group, x).groupBy(*group).applyInPandas(run, schema)
