"""State-space features of series: one task for each series, whose rows are a small matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import ssm
from tidepool.operators.models import dealt


def hankel_columns(df: DataFrame, group: Sequence[str], order: str, values: Sequence[str], rows: int) -> DataFrame:
    """Rows with ``h``: the values of this and the next ``rows`` - 1 rows; rows without so many followers go."""
    by = Window.partitionBy(*group).orderBy(order)
    h = F.array(*[F.lead(v, i).over(by) for i in range(rows) for v in values])
    more = F.lead(order, rows - 1).over(by)
    return df.select(*group, order, h.alias("h"), more.alias("_more")).where("_more is not null").drop("_more")


def _series(rows: pd.DataFrame, order: str, x: str) -> tuple[pd.DataFrame, np.ndarray]:
    rows = rows.sort_values(order)
    return rows, np.stack([np.asarray(v, float) for v in rows[x]])


def _standardised(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``y`` by the mean and deviation of its complete rows, and these."""
    ok = y[~np.isnan(y).any(1)]
    if len(ok) < 2:
        return y, np.zeros(y.shape[1]), np.ones(y.shape[1])
    mean, sd = ok.mean(0), ok.std(0, ddof=1)
    sd = np.where(sd == 0, 1, sd)
    return (y - mean) / sd, mean, sd


def _model(y: np.ndarray, horizon: int, orders: Sequence[int], weights: str, stable: bool) -> tuple | None:
    """``n, aic, a, c, k, solved`` of standardised samples, of which incomplete ones are left out; None if there are too few, they never change, or no order predicts them."""
    y = y[~np.isnan(y).any(1)]
    if len(y) < 2 * horizon * (y.shape[1] + 1) or not np.ptp(y, axis=0).any():
        return None
    shared = ssm.Subspace(y, horizon, weights)
    n, values = ssm.best_order(y, shared, range(min(orders), min(max(orders), horizon * y.shape[1] - 1) + 1), stable)
    if not np.isfinite(min(values)):
        return None
    a, c, k, _ = shared.fit(n, stable)
    return n, min(values), a, c, k, shared.solved


def fitted(df: DataFrame, group: Sequence[str], order: str, x: str, horizon: int = 10, orders: Sequence[int] = range(1, 21), weights: str = "cva", stable: bool = False) -> DataFrame:
    """``n, aic, a, c, k, solved`` of each series' model, of the order with the least AIC; arrays of rows. Series that are too short, or never change, have none.

    ``solved`` is false where the Riccati equation has an eigenvalue on the unit circle, or the model isn't stable: there the gain is the
    recursion's. For ``weights`` and ``stable`` see ``ssm.Subspace``.
    """
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = {g: rows[g].iloc[0] for g in group}
        made = _model(_standardised(_series(rows, order, x)[1])[0], horizon, orders, weights, stable)
        names = ["n", "aic", "a", "c", "k", "solved"]
        if made is None:
            return pd.DataFrame({n: [] for n in [*group, *names]}, dtype=object)
        return pd.DataFrame({**{g: [v] for g, v in keys.items()}, **{n: [v.tolist() if isinstance(v, np.ndarray) else v] for n, v in zip(names, made, strict=True)}})

    nested = "array<array<double>>"
    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], f"n int, aic double, a {nested}, c {nested}, k {nested}, solved boolean"])
    return dealt(df.select(*group, order, x), *group).groupBy(*group).applyInPandas(run, schema)


def recording_states(df: DataFrame, group: Sequence[str], recording: str, order: str, x: str, horizon: int = 10, orders: Sequence[int] = range(1, 21), weights: str = "cva", stable: bool = False) -> DataFrame:
    """``recording, n, state``: the last predicted state of each recording, by the model of its series' standardised samples; the filter starts anew in each.

    A series is fitted and filtered in one task, so neither models nor rows are joined. Incomplete samples don't update the state, and a recording's last complete one has its
    last state. Recordings of series that are too short, and those without a complete sample, give none.
    """
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = {g: rows[g].iloc[0] for g in group}
        rows, y = _series(rows, order, x)
        y, _, _ = _standardised(y)
        made, out = _model(y, horizon, orders, weights, stable), []
        if made is not None:
            n, _, a, c, k, _ = made
            own = rows[recording].to_numpy()
            for r in pd.unique(own):
                z = y[own == r]
                known = np.flatnonzero(~np.isnan(z).any(1))
                if len(known):
                    out.append((r, n, ssm.kalman(z, a, c, k)[0][known[-1]].tolist()))
        found = pd.DataFrame(out, columns=[recording, "n", "state"], dtype=object)
        return pd.DataFrame({**{g: [v] * len(found) for g, v in keys.items()}, **found})

    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], f"{recording} {kinds[recording]}, n int, state array<double>"])
    return dealt(df.select(*group, recording, order, x), *group).groupBy(*group).applyInPandas(run, schema)


def fitted_with_inputs(df: DataFrame, group: Sequence[str], order: str, x: str, u: str, horizon: int = 10, orders: Sequence[int] = range(1, 21)) -> DataFrame:
    """``n, aic, a, b, c, d, k`` of each series' model with inputs (arrays ``x`` of outputs and ``u`` of inputs), of the order with the least AIC; arrays of rows.

    Samples with a missing value are left out; series with too few others, or without a stable model, have none.
    """
    kinds = dict(df.dtypes)
    names = ["n", "aic", "a", "b", "c", "d", "k"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = {g: rows[g].iloc[0] for g in group}
        rows, y = _series(rows, order, x)
        given = np.stack([np.asarray(v, float) for v in rows[u]])
        ok = ~(np.isnan(y).any(1) | np.isnan(given).any(1))
        y, given, best = y[ok], given[ok], None
        if len(y) >= 2 * horizon * (y.shape[1] + given.shape[1] + 1):
            shared = ssm.InputSubspace(y, given, horizon)
            for n in range(min(orders), min(max(orders), (horizon - 1) * y.shape[1]) + 1):
                made = shared.fit(n)
                if made is None:
                    continue
                value = ssm.aic(y, ssm.predicted(y, given, *made), (2 * y.shape[1] + 1 + given.shape[1]) * n + y.shape[1] * given.shape[1])
                if np.isfinite(value) and (best is None or value < best[1]):
                    best = (n, value, *(v.tolist() for v in made))
        return pd.DataFrame({**{g: [v] for g, v in keys.items()}, **{n: [v] for n, v in zip(names, best, strict=True)}}) if best else pd.DataFrame({n: [] for n in [*group, *names]}, dtype=object)

    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "n int, aic double", *[f"{n} array<array<double>>" for n in names[2:]]])
    return dealt(df.select(*group, order, x, u), *group).groupBy(*group).applyInPandas(run, schema)


def states(df: DataFrame, models: DataFrame, group: Sequence[str], order: str, x: str) -> DataFrame:
    """Rows with ``state`` and ``guess``: one-step predictions of each series by its model."""
    kinds = dict(df.dtypes)
    joined = df.select(*group, order, x).join(models.select(*group, "a", "c", "k"), list(group))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, y = _series(rows, order, x)
        a, c, k = (np.array([list(r) for r in rows[m].iloc[0]]) for m in ("a", "c", "k"))
        state, guess, _ = ssm.kalman(y, a, c, k)
        return pd.DataFrame({**{g: rows[g].to_numpy() for g in group}, order: rows[order].to_numpy(), "state": state.tolist(), "guess": guess.tolist()})

    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], f"{order} {kinds[order]}, state array<double>, guess array<double>"])
    return joined.groupBy(*group).applyInPandas(run, schema)


def last_state(filtered: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last state of each recording."""
    return filtered.where(F.col("state").isNotNull()).groupBy(*key).agg(F.max_by("state", order).alias("state"))


def mean_power(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The mean over a recording's windows, where there is no model."""
    return df.groupBy(*key).agg(F.avg(value).alias("power"))


def warmed_trials(df: DataFrame, group: Sequence[str], trial: str) -> DataFrame:
    """Each trial's rows with the ones of the trial before, marked ``is_warm_up``; ``run`` is the trial; the first goes."""
    own = df.select("*", F.col(trial).alias("run"), F.lit(False).alias("is_warm_up"))
    before = df.select("*", (F.col(trial) + 1).alias("run"), F.lit(True).alias("is_warm_up"))
    first = df.groupBy(*group).agg(F.min(trial).alias("_a"), F.max(trial).alias("_b"))
    return own.unionByName(before).join(first, list(group)).where("run > _a and run <= _b").drop("_a", "_b")
