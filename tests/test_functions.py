"""Numeric helpers against published values, other derivations and invariants."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepool.functions import dsp, linmod, quantiles, ssm


def test_quantiles():
    assert quantiles.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert quantiles.chi2_quantile(0.95, 10) == pytest.approx(18.307038, abs=1e-6)
    assert quantiles.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-7)
    assert quantiles.clopper_pearson(0, 10) == pytest.approx((0.0, 0.308497), abs=1e-5)
    assert quantiles.clopper_pearson(5, 10) == pytest.approx((0.187086, 0.812914), abs=1e-5)


@given(st.floats(0.01, 0.99), st.floats(0.5, 30), st.floats(0.5, 30))
@settings(max_examples=50, deadline=None)
def test_beta_inverse(p, a, b):
    assert quantiles.beta_cdf(quantiles.beta_quantile(p, a, b), a, b) == pytest.approx(p, abs=1e-7)


def test_tapers_are_orthonormal():
    t = dsp.tapers(64, 3.0, 5)
    assert np.allclose(t.T @ t, np.eye(5), atol=1e-9)
    energy = [np.abs(np.fft.fft(t[:, i], 4096))[: int(3 * 4096 / 64) + 1] for i in range(3)]
    assert all(2 * (e[1:] ** 2).sum() + e[0] ** 2 > 0.99 * 4096 for e in energy)


def test_multitaper_finds_a_sine_and_keeps_variance():
    fs, n = 128.0, 256
    t = np.arange(n) / fs
    f, s = dsp.multitaper(np.sin(2 * np.pi * 20 * t), fs, fpass=(0, 64))
    assert abs(f[s.argmax()] - 20) <= 2
    x = np.random.default_rng(0).normal(size=4096)
    f, s = dsp.multitaper(x, fs, fpass=(0, 64))
    assert 2 * s.sum() * (f[1] - f[0]) == pytest.approx(x.var(), rel=0.1)


@pytest.mark.parametrize(("cut", "kind", "passes", "stops"), [(10.0, "lowpass", 1.0, 40.0), (10.0, "highpass", 40.0, 1.0), ((18.0, 22.0), "bandstop", 2.0, 19.9)])
def test_butterworth_gain(cut, kind, passes, stops):
    fs = 128.0
    sos = dsp.butterworth(4, cut, fs, kind)

    def gain(f):
        z = np.exp(-2j * np.pi * f / fs)
        return abs(np.prod([(b[0] + b[1] * z + b[2] * z * z) / (b[3] + b[4] * z + b[5] * z * z) for b in sos]))

    assert gain(passes) == pytest.approx(1, abs=0.02) and gain(stops) < 0.02
    assert gain(np.atleast_1d(cut)[0]) == pytest.approx(math.sqrt(0.5), abs=1e-6)


def test_butterworth_rejects_bad_edges():
    for cut, kind in ((80.0, "lowpass"), ((5.0, 4.0), "bandstop"), (5.0, "bandstop")):
        with pytest.raises(ValueError):
            dsp.butterworth(4, cut, 128.0, kind)


def test_filter_in_chunks_is_filter_in_one():
    sos = dsp.butterworth(4, 10.0, 128.0, "lowpass")
    x = np.random.default_rng(1).normal(size=300)
    x[50] = np.nan
    whole, _ = dsp.filter_sections(sos, x)
    a, state = dsp.filter_sections(sos, x[:120])
    b, _ = dsp.filter_sections(sos, x[120:], state)
    assert np.allclose(whole, np.concatenate([a, b]), equal_nan=True) and np.isnan(whole[50])


def test_zero_phase_keeps_a_slow_sine():
    t = np.arange(512) / 128
    x = np.sin(2 * np.pi * 2 * t)
    y = dsp.filter_both_ways(dsp.butterworth(4, 20.0, 128.0, "lowpass"), x)
    assert np.abs(y - x)[50:-50].max() < 0.01
    z = dsp.fir_both_ways(dsp.fir(128.0, 0, 20.0, 65), x)
    assert np.abs(z - x)[100:-100].max() < 0.05


def test_lda_equals_explicit_inverse():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(float)
    w, b = linmod.lda(x, y, 0.3)
    share = y.mean()
    cov = sum(p * ((1 - 0.3) * np.cov(x[y == k].T, bias=True) + 0.3 * np.trace(np.cov(x[y == k].T, bias=True)) / 4 * np.eye(4)) for k, p in ((0, 1 - share), (1, share)))
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    inverse = np.linalg.inv(cov)
    assert np.allclose(w, inverse @ (m1 - m0))
    assert b == pytest.approx(-0.5 * (m1 + m0) @ inverse @ (m1 - m0) + math.log(share / (1 - share)))


def test_lasso_optimality_and_ridge_recovery():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(100, 5))
    beta = np.array([1.0, 2.0, 0.0, -1.0, 3.0])
    y = x @ beta + rng.normal(size=100) / 10
    w, b = linmod.lasso(x, y, 0.1, tol=1e-10)
    grad = (x - x.mean(0)).T @ (y - x @ w - b) / 100
    assert np.all(np.abs(grad) <= 0.1 + 1e-6) and np.allclose(grad[w != 0], 0.1 * np.sign(w[w != 0]), atol=1e-6)
    w, b = linmod.ridge(x, y, linmod.ridge_penalty(x, y))
    assert 1 - ((y - x @ w - b) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.99


def test_logistic_and_machine_separate():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=200) > 0).astype(float)
    w, b = linmod.logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose(x.T @ (y - p), 0, atol=1e-4) and linmod.auc(y, p) > 0.9
    ring = (np.hypot(*x.T) > 1).astype(float)
    rows, a, b = linmod.rbf_svm(x, ring, 10.0, 1.0)
    score = np.exp(-((x[:, None] - rows[None]) ** 2).sum(-1)) @ a + b
    assert linmod.auc(ring, score) > 0.95


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=2, max_size=40))
@settings(max_examples=100, deadline=None)
def test_auc_is_the_share_of_ordered_pairs(rows):
    y, s = (np.array(c, float) for c in zip(*rows, strict=True))
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    got = linmod.auc(y, s)
    assert (math.isnan(got) and not pairs) or got == pytest.approx(np.mean(pairs))


def test_state_space_predicts_an_oscillation():
    rng = np.random.default_rng(5)
    a = 0.98 * np.array([[math.cos(0.3), -math.sin(0.3)], [math.sin(0.3), math.cos(0.3)]])
    x, out = np.zeros(2), []
    for _ in range(1500):
        x = a @ x + rng.normal(size=2) * 0.1
        out.append([x[0] + rng.normal() * 0.05, x[1] + rng.normal() * 0.05])
    y = np.array(out)
    n, values = ssm.best_order(y, ssm.Subspace(y, 5), range(1, 5))
    fa, fc, fk, _ = ssm.Subspace(y, 5).fit(2)
    roots = np.linalg.eigvals(fa)
    assert np.allclose(np.abs(roots), 0.98, atol=0.03) and np.allclose(np.abs(np.angle(roots)), 0.3, atol=0.03)
    guesses = ssm.kalman(y, fa, fc, fk)[1]
    assert ((y - guesses)[100:] ** 2).mean() < 0.3 * y.var() and n >= 2


def test_kalman_without_gain_and_with_gaps():
    a, c = np.array([[0.5]]), np.array([[1.0]])
    states, _, _ = ssm.kalman(np.zeros((4, 1)), a, c, np.zeros((1, 1)), np.array([8.0]))
    assert states.ravel().tolist() == [8, 4, 2, 1]
    y = np.array([[1.0], [np.nan], [1.0]])
    states, _, last = ssm.kalman(y, a, c, np.array([[0.4]]))
    assert states[2] == a @ states[1]


def test_riccati_equals_its_recursion():
    rng = np.random.default_rng(6)
    for n, p in ((1, 1), (3, 2), (4, 1)):
        a, c = rng.normal(size=(n, n)), rng.normal(size=(p, n))
        a *= 0.9 / np.abs(np.linalg.eigvals(a)).max()
        noise = rng.normal(size=(n + p, n + p + 3))
        cov = noise @ noise.T
        parts = cov[:n, :n], cov[n:, n:], cov[:n, n:]
        k, e = ssm.steady(a, c, *parts)
        k_steps, e_steps = ssm.gain(a, c, *parts, steps=5000)
        assert np.allclose(k, k_steps, atol=1e-6) and np.allclose(e, e_steps, rtol=1e-6)
    one = np.ones((1, 1))
    assert ssm.riccati(one, 0 * one, 0 * one, one) is None  # its eigenvalues are on the unit circle
    assert ssm.steady(one, one, one, one, 0 * one) is None


def test_subspaces_of_other_weights_are_stable():
    rng = np.random.default_rng(7)
    a = 0.9 * np.array([[math.cos(0.5), -math.sin(0.5)], [math.sin(0.5), math.cos(0.5)]])
    x, out = np.zeros(2), []
    for _ in range(3000):
        x = a @ x + rng.normal(size=2)
        out.append([x[0] + rng.normal() * 0.1])
    for weights in ("cva", "sv"):
        for stable in (False, True):
            shared = ssm.Subspace(np.array(out), 8, weights)
            roots = np.linalg.eigvals(shared.fit(2, stable)[0])
            assert shared.solved and np.abs(roots).max() < 1
            assert np.allclose(np.abs(roots), 0.9, atol=0.06) and np.allclose(np.abs(np.angle(roots)), 0.5, atol=0.06), (weights, stable)
    walk = rng.normal(size=(300, 1)).cumsum(0) + np.arange(300)[:, None] ** 2 / 100
    for order in range(1, 5):
        assert np.abs(np.linalg.eigvals(ssm.Subspace(walk, 5, "sv").fit(order, True)[0])).max() < 1 + 1e-9
    with pytest.raises(ValueError):
        ssm.Subspace(walk, 5, "other")


def test_machines_are_optimal_and_searched():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2))
    y = (np.hypot(*x.T) > 1).astype(float)
    signs = 2 * y - 1
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    boxes, scales = np.array([0.1, 1.0, 10.0]), np.array([0.5, 1.0, 3.0])
    kernels = np.exp(-distance / scales[:, None, None] ** 2)
    w, b = linmod.kernel_machines(kernels, y, boxes)
    for k, box, wi, bi in zip(kernels, boxes, w, b, strict=True):
        alpha, margin = wi * signs, signs * (k @ wi + bi)
        assert abs(wi.sum()) < 1e-9 and alpha.min() >= 0 and alpha.max() <= box
        assert (margin[alpha <= 0] > 1 - 2e-3).all() and (margin[alpha >= box] < 1 + 2e-3).all()
        assert np.abs(margin[(alpha > 0) & (alpha < box)] - 1).max(initial=0) < 2e-3
    rows, weights, intercept, box, scale = linmod.searched_machine(x, y)
    fresh = rng.normal(size=(500, 2))
    score = np.exp(-((fresh[:, None] - rows[None]) ** 2).sum(-1) / scale**2) @ weights + intercept
    assert 1e-3 <= box <= 1e3 and 1e-3 <= scale <= 1e3 and linmod.auc((np.hypot(*fresh.T) > 1).astype(float), score) > 0.95


def test_orders_whose_predictions_outgrow_numbers():
    """A series whose samples come several times each: some orders' predictors aren't stable, and the search goes on without them."""
    import duckdb

    from tidepool.operators import statespace

    events = duckdb.sql("select user_id, value, length(event_type) kind from '/root/testdata/sf0.1/events.parquet' where user_id < 100 order by user_id, ts, event_id").df()
    outgrown = 0
    for _, g in events.groupby("user_id"):
        y = statespace._standardised(np.repeat(g[["value", "kind"]].to_numpy(float), 6, axis=0))[0]
        shared = ssm.Subspace(y, 10)
        n, values = ssm.best_order(y, shared, range(1, 20))
        assert np.isfinite(values[n - 1]) and values[n - 1] == min(values)
        outgrown += np.isinf(values).any()
        if outgrown:
            break
    assert outgrown
    assert statespace._model(np.zeros((200, 2)), 10, range(1, 21), "cva", False) is None
    assert ssm.aic(np.zeros((3, 1)), np.array([[0.0], [1e200], [np.nan]]), 1) == np.inf


def test_filter_by_stretches():
    """Predictions of a long series by stretches side by side equal those of its samples one by one."""
    rng = np.random.default_rng(4)
    for t, n in ((1, 1), (2, 3), (50, 4), (1003, 7)):
        a, c, k = rng.normal(size=(n, n)), rng.normal(size=(2, n)), rng.normal(size=(n, 2)) * 0.1
        a = a * 0.9 / np.abs(np.linalg.eigvals(a)).max()
        k *= 0.1
        y = rng.normal(size=(t, 2))
        assert np.allclose(ssm.filtered(y, a, c, k), ssm.kalman(y, a, c, k)[1], atol=1e-9)


def test_next_power_of_zero(spark):
    from tidepool.functions import columns

    rows = spark.createDataFrame([(0.0,), (0.3,), (4.0,), (5.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(columns.next_power_of_two(rows["v"])).collect()] == [0.0, 0.5, 4.0, 8.0, None]


def test_ridge_penalties_together(monkeypatch):
    """The penalty chosen from all penalties' errors by a fold's axes is the one of systems solved one by one, none of which is solved here."""
    rng = np.random.default_rng(9)
    for n, p in ((30, 3), (66, 64), (40, 64)):
        x = rng.normal(size=(n, p))
        x[:, -1] = 2.0
        y = x[:, 0] + rng.normal(size=n) * 0.5
        grid, parts = np.logspace(-4, 5, 100), np.array_split(np.arange(n), 10)
        errors = np.empty((100, 10))
        for j, test in enumerate(parts):
            train = np.setdiff1d(np.arange(n), test)
            for i, k in enumerate(grid):
                w, b = linmod.ridge(x[train], y[train], k)
                errors[i, j] = np.sqrt(np.mean((y[test] - x[test] @ w - b) ** 2))
        mean = errors.mean(1)
        limit = mean.min() + errors[mean.argmin()].std(ddof=1) / np.sqrt(10)
        with monkeypatch.context() as m:
            m.setattr(linmod, "ridge", None)
            assert linmod.ridge_penalty(x, y) == grid[np.flatnonzero(mean <= limit)[0]]


def test_inputs_meet_states_without_products_for_each_sample(monkeypatch):
    """B, D of a known A, C without noise, and no Kronecker product for each sample."""
    rng = np.random.default_rng(3)
    a, b, c, d = np.array([[0.7, 0.2], [-0.1, 0.5]]), rng.normal(size=(2, 2)), rng.normal(size=(2, 2)), rng.normal(size=(2, 2))
    u, x, y = rng.normal(size=(300, 2)), np.zeros(2), []
    for v in u:
        y.append(c @ x + d @ v)
        x = a @ x + b @ v
    made = ssm.InputSubspace(np.array(y), u, 4)
    monkeypatch.setattr(np, "kron", None)
    found = made._inputs_of(a, c)
    assert np.allclose(found[0], b, atol=1e-8) and np.allclose(found[1], d, atol=1e-8)


def test_stacked_lassos_end_on_the_minimum():
    """Gradients are the penalty times the sign, or less where a coefficient is 0; with more rows than features, with fewer, and with equal features by the same predictions."""
    rng = np.random.default_rng(3)
    for n, p in ((100, 64), (56, 64), (90, 8), (12, 1)):
        x, y = rng.normal(size=(n, p)), rng.normal(size=(n, 40))
        x, y = x - x.mean(0), y - y.mean(0)
        gram, xy, weight = x.T @ x, x.T @ y, 1e-2 * n
        w = linmod.stacked_lasso(gram[None], xy[None], np.array([n]), 1e-2)[0]
        rest = xy - gram @ w
        assert np.abs(np.where(w != 0, rest - weight * np.sign(w), 0)).max() < 1e-6 * weight and (np.abs(rest) < weight * (1 + 1e-6)).all()
        assert (w == 0).any() and ((w != 0).sum(0) <= min(n - 1, p)).all()
    twice = np.column_stack([x, x, np.zeros(n)])
    both = linmod.stacked_lasso((twice.T @ twice)[None], (twice.T @ y)[None], np.array([n]), 1e-2)[0]
    assert np.allclose(twice @ both, x @ w, atol=1e-3)


def test_folded_discriminants_are_those_of_each_fold():
    """With gaps about a fold, folds without training rows of a class, and one fold of all rows."""
    rng = np.random.default_rng(5)
    x, ones = rng.normal(size=(40, 6)), rng.random((30, 40)) < 0.5
    ones[0] = np.arange(40) < 4
    trained = np.ones((9, 40), bool)
    for fold in range(8):
        trained[fold, max(fold * 5 - 2, 0) : fold * 5 + 7] = False
    for priors, target in ((None, "identity"), ((0.5, 0.5), "diagonal")):
        w, b, fit = linmod.folded_lda(x, ones, trained, priors, target)
        assert not fit[0, 0] and fit[1:].all()
        for fold, train in enumerate(trained):
            for perm in np.flatnonzero(fit[:, fold]):
                there, at = linmod.stacked_lda(x, ones[perm : perm + 1], train[None], priors, target)
                assert np.allclose(w[perm, fold], there[0], atol=1e-10) and abs(b[perm, fold] - at[0]) < 1e-10


def test_recursion_by_doubling(monkeypatch):
    """A gain of 500 steps takes few inverses, and is the one of steps made one by one; so is a recursion that hasn't ended by then."""
    rng = np.random.default_rng(8)
    inverse, calls = np.linalg.inv, []
    monkeypatch.setattr(np.linalg, "inv", lambda m: calls.append(1) or inverse(m))
    for n, steps in ((1, 500), (3, 500), (8, 500), (8, 1), (8, 2), (8, 37)):
        a, c, root = rng.normal(size=(n, n)), rng.normal(size=(2, n)), rng.normal(size=(n + 2, n + 2)) * 0.1
        a = a * 1.05 / np.abs(np.linalg.eigvals(a)).max()
        noise = root @ root.T
        q, r, s = noise[:n, :n], noise[n:, n:], noise[:n, n:]
        p = q
        for _ in range(steps):
            e = c @ p @ c.T + r
            k = (a @ p @ c.T + s) @ inverse(e)
            p = a @ p @ a.T + q - k @ e @ k.T
            p = (p + p.T) / 2
        calls.clear()
        found, spread = ssm.gain(a, c, q, r, s, steps)
        assert len(calls) < 30 and np.allclose(found, k, atol=1e-8) and np.allclose(spread, e, atol=1e-8)
    still = ssm.gain(np.diag([1.1, 0.5]), np.array([[0.0, 1.0]]), np.eye(2) * 0.1, np.zeros((1, 1)), np.zeros((2, 1)))[0]  # nothing tells of the first state; no noise of the output
    assert np.allclose(still[1], 0.5)


def test_orders_of_samples_that_come_many_times():
    """Few singular values of such a series are more than rounding, so it has few orders; predictions that run away along one line aren't taken for exact."""
    import duckdb

    from tidepool.operators import statespace

    events = duckdb.sql("select user_id, value, length(event_type) kind from '/root/testdata/sf0.1/events.parquet' where user_id < 10 order by user_id, ts, event_id").df()
    for _, g in events.groupby("user_id"):
        y = statespace._standardised(np.repeat(g[["value", "kind"]].to_numpy(float), 60, axis=0))[0]
        shared = ssm.Subspace(y, 10)
        rank = (shared.s > 1e-10 * shared.s[0]).sum()
        n, values = ssm.best_order(y, shared, range(1, 20))
        assert rank < 19 and n <= rank and np.isinf(values[rank:]).all() and np.isfinite(values[n - 1])
        a, c, k, _ = shared.fit(n)
        assert np.abs(np.linalg.eigvals(a - k @ c)).max() < 1
    y = np.random.default_rng(2).normal(size=(4000, 2))
    away = np.outer(1.03 ** np.arange(4000), [2.0, 1.0])
    assert ssm.aic(y, away, 1) == np.inf
    e = y - 0.3
    assert abs(ssm.aic(y, np.full_like(y, 0.3), 3) - (4000 * np.linalg.slogdet(e.T @ e / 4000)[1] + 6)) < 1e-6


def test_discriminants_of_few_features_are_those_of_each_fold():
    """All folds and permutations at once, against one by one: also of fewer rows than have an inverse, of values close together, and of many rows with a gap."""
    rng = np.random.default_rng(12)
    for n, p, perms, kind in ((10, 1, 40, ""), (12, 2, 60, ""), (16, 4, 20, ""), (40, 3, 6, ""), (90, 2, 4, ""), (90, 2, 4, "close"), (12, 2, 30, "close")):
        x = rng.normal(size=(n, p))
        if kind:
            x[: n // 2] = x[: n // 2] * 1e-3 + 5
        x = (x - x.mean(0)) / x.std(0)
        ones = np.array([rng.permutation(n) < n // 2 for _ in range(perms)])
        ones[0] = np.arange(n) < n // 2
        trained = np.abs(np.arange(n)[:, None] - np.arange(n)) > 4
        w, b, fit = linmod.folded_lda(x, ones, trained, (0.5, 0.5), "diagonal")
        for perm in range(perms):
            for fold, train in enumerate(trained):
                both = train.sum() >= 3 and len(set(ones[perm, train])) == 2
                assert fit[perm, fold] == both
                if both:
                    there, at = linmod.lda(x[train], ones[perm, train] * 1.0, "auto", (0.5, 0.5), "diagonal")
                    found, expected = x[fold] @ w[perm, fold] + b[perm, fold], x[fold] @ there + at
                    assert abs(found - expected) <= 1e-6 * max(abs(expected), 1), (n, p, kind)


def test_areas_of_many():
    rng = np.random.default_rng(13)
    y, score = (rng.random((50, 20)) < 0.5) * 1.0, rng.integers(0, 6, (50, 20)) / 4
    score[rng.random((50, 20)) < 0.3] = np.nan
    y[0], score[1] = 1.0, np.nan
    found = linmod.areas(y, score)
    for own, truth, s in zip(found, y, score, strict=True):
        known = ~np.isnan(s)
        expected = linmod.auc(truth[known], s[known])
        assert own == expected or (np.isnan(own) and np.isnan(expected))
    assert np.isnan(found[:2]).all() and not np.isnan(found).all()
