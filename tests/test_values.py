"""Rows of the queries that SQL can't express, against plain NumPy by other derivations."""

import math
from functools import cache

import duckdb
import numpy as np
import pytest

from tidepool.functions import dsp, linmod
from tidepool.queries import PERMUTATIONS, QUERIES, SHUFFLES, labelled

SF = "/root/testdata/sf0.001"


@cache
def samples():
    rows = duckdb.sql(f"select user_id, list(value order by ts, event_id) from '{SF}/events.parquet' group by 1").fetchall()
    return {u: np.array(v) for u, v in rows}


@cache
def vectors():
    rows = duckdb.sql(f"select vec_id, cast(embedding as double[]) from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


@pytest.fixture(scope="module")
def rows(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = QUERIES[name](spark, SF).toPandas()
        return made[name]

    return get


def scores(rows):
    """vec_id: score, of the model queries, from one that returns it."""
    return dict(zip(*rows("m11_transfer")[["vec_id", "truth"]].to_numpy().T, strict=True))


# Spectra ----------------------------------------------------------------------------------------


def kernel(n, nw=3.0):
    i = np.subtract.outer(np.arange(n), np.arange(n))
    return 2 * nw / n * np.sinc(2 * nw / n * i)


@cache
def dense_tapers(n, nw=3.0, k=5):
    i = np.arange(n)
    off = i[1:] * (n - i[1:]) / 2
    return np.linalg.eigh(np.diag(((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * nw / n)) + np.diag(off, 1) + np.diag(off, -1))[1][:, ::-1][:, :k]


def dft(x, nfft, bins):
    return np.exp(-2j * np.pi * np.outer(bins, np.arange(len(x))) / nfft) @ x


def powers(x, fs, w, nfft, f):
    return np.array([np.abs(dft(x * t, nfft, f * nfft / fs)) ** 2 / fs for t in w.T])


def test_spectra_and_limits(rows):
    chi2 = {10: (20.483177, 3.246973), 9: (19.022768, 2.700389)}
    for name, dof in (("h1_h5_spectrum", lambda n: 10), ("h7_finite_size", lambda n: int(1 / (0.1 + 1 / (2 * n))))):
        for user, g in rows(name).groupby("user_id"):
            x = samples()[user]
            w = np.linalg.eigh(kernel(len(x)))[1][:, -5:]  # any basis of their span gives the same mean
            s = powers(x, 16.0, w, dsp.fft_size(len(x)), g.f.to_numpy()).mean(0)
            assert np.allclose(g.power, s, rtol=1e-5)
            high, low = chi2[dof(len(x))]
            assert np.allclose(g.low, s * dof(len(x)) / high, rtol=1e-5) and np.allclose(g.high, s * dof(len(x)) / low, rtol=1e-5)


def test_jackknife(rows):
    for user, g in rows("h7_jackknife").groupby("user_id"):
        x = samples()[user]
        p = powers(x, 16.0, dense_tapers(len(x)), dsp.fft_size(len(x)), g.f.to_numpy())
        logs = np.log([np.delete(p, j, 0).mean(0) for j in range(5)])
        spread = 2.776445105 * np.sqrt(4 * ((logs - logs.mean(0)) ** 2).mean(0))
        assert np.allclose(np.log(g.high / g.power), spread, rtol=1e-5) and np.allclose(np.log(g.power / g.low), spread, rtol=1e-5)


def test_spectrograms(rows):
    for user, g in rows("h6_spectrogram").groupby("user_id"):
        x = samples()[user]
        for t, h in g.groupby("t"):
            at = round((t - 0.5) * 16)
            assert np.allclose(h.power, powers(x[at : at + 16], 16.0, dense_tapers(16), 16, h.f.to_numpy()).mean(0), rtol=1e-6, atol=1e-9)
    for user, g in rows("h8_welch").groupby("user_id"):
        x, window = samples()[user], np.hamming(8)
        for t, h in g.groupby("t"):
            at = round((t - 1) * 16)
            parts = [x[at + k : at + k + 8] * window for k in range(0, 25, 4)]
            s = np.mean([np.abs(dft(p, 256, h.f.to_numpy() * 16)) ** 2 for p in parts], 0) / (16 * (window**2).sum())
            s[(h.f.to_numpy() > 0) & (h.f.to_numpy() < 8)] *= 2
            assert np.allclose(h.power, s, rtol=1e-6)
    x = samples()[rows("h8_wavelet").user_id.min()]
    g = rows("h8_wavelet").query(f"user_id == {rows('h8_wavelet').user_id.min()} and f == 3")
    nfft = dsp.fft_size(2 * len(x))
    grid = np.arange(1, nfft // 2) * 16 / nfft
    z = np.array([(2 * np.exp(-((grid - 3) ** 2) / (2 * (3 / 7) ** 2)) * dft(x, nfft, np.arange(1, nfft // 2)) * np.exp(2j * np.pi * grid * t)).sum() / nfft for t in g.t])
    assert np.allclose(g.power, np.abs(z) ** 2, rtol=1e-6)


def test_scaled_spectrograms(rows):
    plain = {}
    for user, x in samples().items():
        own = x[8:56]
        at = range(0, len(own) - 15, 8)
        p = np.log10([powers(own[a : a + 16], 16.0, dense_tapers(16), 16, np.arange(9.0)).mean(0) for a in at])
        z = (p - p.mean(0)) / p.std(0, ddof=1)
        for a, line in zip(at, z, strict=True):
            for f, v in enumerate(line):
                plain.setdefault((user % 2, (a + 8) / 16, float(f)), []).append(v)
    got = {(r.half, r.t, r.f): (r.power, r.n) for r in rows("h8_options").itertuples()}
    assert got.keys() == plain.keys()
    assert all(abs(got[k][0] - np.mean(v)) < 1e-6 and got[k][1] == len(v) for k, v in plain.items())


def test_band_powers(rows):
    for name in ("h11_band_powers", "h11_welch"):
        for (user, window, band), g in rows(name).groupby(["user_id", "window", "band"]):
            x = samples()[user][window * 32 : window * 32 + 32]
            f = np.arange(0, 33) * 0.5 if name == "h11_band_powers" else np.arange(129) / 16
            f = f[(f >= (1 if band == "low" else 3)) & (f < (3 if band == "low" else 8))]
            if name == "h11_welch":
                w, parts = np.hamming(8), [x[k : k + 8] for k in range(0, 25, 4)]
                s = 2 * np.pi * 2 * np.mean([np.abs(dft(p * w, 256, f * 16)) ** 2 for p in parts], 0) / (16 * (w**2).sum())
            else:
                tapers = dense_tapers(32, 2.0, 3)
                p, inside = powers(x, 16.0, tapers, 32, f) * 16, np.diag(tapers.T @ kernel(32, 2.0) @ tapers)[:, None]
                s, total = p[:2].mean(0), (x**2).mean()
                for _ in range(300):
                    weight = (s / (s * inside + total * (1 - inside))) ** 2 * inside
                    s = (weight * p).sum(0) / weight.sum(0)
            assert abs(g.db.iloc[0] - 10 * np.log10(s.mean())) < 0.02, name


# Filters ----------------------------------------------------------------------------------------


def one_way(sos, x):
    y = np.array(x, float)
    for b0, b1, b2, _, a1, a2 in sos:
        out = np.zeros(len(y))
        for i in range(len(y)):
            past = lambda v, k: v[i - k] if i >= k else 0.0  # noqa: B023, E731
            out[i] = b0 * y[i] + b1 * past(y, 1) + b2 * past(y, 2) - a1 * past(out, 1) - a2 * past(out, 2)
        y = out
    return y


def both_ways(filtered, x, pad):
    pad = min(len(x) - 1, pad)
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return filtered(filtered(long)[::-1])[::-1][pad : pad + len(x)]


def test_designs():
    from tidepool.queries import DESIGNS, LEAST_SQUARES

    for kind, edges, ends in (("lowpass", [4.0], (1, 0)), ("highpass", [1.0], (0, 1)), ("bandstop", [3.0, 5.0], (1, 1))):
        sos = np.array(DESIGNS[kind]).reshape(-1, 6)
        gain = lambda f: abs(np.prod([(s[:3] @ np.exp(-2j * np.pi * f / 16 * np.arange(3))) / (s[3:] @ np.exp(-2j * np.pi * f / 16 * np.arange(3))) for s in sos]))  # noqa: B023, E731
        assert np.allclose([gain(f) for f in edges], np.sqrt(0.5), atol=1e-9) and np.allclose([gain(1e-9), gain(8 - 1e-9)], ends, atol=1e-6)
    h = np.array(LEAST_SQUARES)
    at = np.concatenate([np.linspace(a, b, 4001) for a, b in ((0, 0.2), (0.3, 0.6), (0.7, 1))])
    goal, waves = ((at >= 0.3) & (at <= 0.6)) * 1.0, np.cos(np.outer(at, np.arange(13)) * np.pi)
    weight = np.concatenate([np.r_[0.5, np.ones(3999), 0.5] * w for w in (0.2, 0.3, 0.3)])
    c = np.linalg.solve((waves * weight[:, None]).T @ waves, waves.T @ (weight * goal))
    assert np.allclose(h, np.concatenate([c[:0:-1] / 2, c[:1], c[1:] / 2]), atol=1e-5)


def test_filtered_recordings(rows):
    got = {n: dict(zip(rows(n).user_id, rows(n).samples, strict=True)) for n in ("h13_fir", "h16_preprocessed", "h18_band_stops", "h19_acute_filtered")}
    h = dsp.fir(16.0, 2.0, 6.0)
    acute = [dsp.butterworth(4, c, 420.1, "bandstop") for c in ((66, 70), (81, 85), (103, 107), (103, 107), (126, 130))] + [dsp.butterworth(4, 1.0, 420.1, "highpass")]
    stops = {0: [(2, 2.0, 3.0)], 1: [(2, 4.0, 5.0), (4, 6.0, 7.0)], 2: []}
    for user, x in samples().items():
        assert np.allclose(got["h13_fir"][user], both_ways(lambda v: np.array([sum(h[k] * v[i - k] for k in range(min(i + 1, len(h)))) for i in range(len(v))]), x, len(h) - 1), atol=1e-8)
        y = x[::2]
        for sos in (dsp.butterworth(4, 0.5, 16.0, "highpass"), dsp.butterworth(4, 6.0, 16.0, "lowpass"), dsp.butterworth(4, (3.0, 7.0), 16.0, "bandstop")):
            y = both_ways(lambda v: one_way(sos, v), y, 6 * len(sos) + 3)  # noqa: B023
        assert np.allclose(got["h16_preprocessed"][user], y, atol=1e-6)
        y = x
        for order, low, high in stops[user % 3]:
            sos = dsp.butterworth(order, (low, high), 16.0, "bandstop")
            y = both_ways(lambda v: one_way(sos, v), y, 6 * len(sos) + 3)  # noqa: B023
        assert np.allclose(got["h18_band_stops"][user], y, atol=1e-6)
        y = x
        for sos in acute:
            y = one_way(sos, y)
        assert np.allclose(got["h19_acute_filtered"][user], y, atol=1e-6)


def test_envelopes_of_bands(rows):
    g = rows("h8_hilbert")
    for user in sorted(samples())[:3]:
        x = samples()[user]
        for f, (low, high) in ((2.0, (1, 3)), (4.5, (3, 6))):
            h = dsp.fir(16.0, low, high)
            y = both_ways(lambda v: np.convolve(v, h)[: len(v)], x, len(h) - 1)  # noqa: B023
            n = len(y)
            s = dft(y, n, np.arange(n)) * np.array([1 if k == 0 or 2 * k == n else 2 if 2 * k < n else 0 for k in range(n)])
            z = np.array([(s * np.exp(2j * np.pi * np.arange(n) * t / n)).sum() / n for t in range(0, n, 8)])
            assert np.allclose(g[(g.user_id == user) & (g.f == f)].sort_values("t").power, np.abs(z) ** 2, rtol=1e-6, atol=1e-8)


# Models -----------------------------------------------------------------------------------------


def shrunk(x, diagonal=False):
    """Ledoit and Wolf's covariance by their sums over samples."""
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    goal = np.diag(np.diag(s)) if diagonal else np.eye(p) * np.trace(s) / p
    off = 1 - np.eye(p) if diagonal else np.ones((p, p))
    b = sum((((np.outer(v, v) - s) ** 2) * off).sum() for v in x) / n**2
    share = min(1.0, b / ((s - goal) ** 2).sum())
    return share * goal + (1 - share) * s


def discriminant(x, y, priors=None, diagonal=False):
    """Coefficients and intercept from two normal densities of one covariance."""
    share = priors or [(y == c).mean() for c in (0, 1)]
    sd = [x[y == c].std(0) for c in (0, 1)]
    cov = sum(p * np.diag(d) @ shrunk(x[y == c] / d, diagonal) @ np.diag(d) for p, c, d in zip(share, (0, 1), sd, strict=True))
    m0, m1 = (x[y == c].mean(0) for c in (0, 1))
    w = np.linalg.solve(cov, m1 - m0)
    return w, -w @ (m0 + m1) / 2 + math.log(share[1] / share[0])


def scaled(x, like):
    return (x - like.mean(0)) / like.std(0)


def subject(rows, k, score=False):
    ids, x = vectors()
    own = ids // 100 == k
    noisy = np.array([scores_of(rows)[i] for i in ids[own]])
    return ids[own], x[own], noisy if score else (noisy >= np.median(noisy)) * 1.0


def scores_of(rows):
    return dict(zip(rows("m7_ridge").vec_id, rows("m7_ridge").truth, strict=True))


def expected_scores(x, y, folds, gap=0, per_fold=False, priors=None, diagonal=False):
    out = np.zeros(len(y))
    for test in np.array_split(np.arange(len(y)), folds):
        train = np.ones(len(y), bool)
        train[max(test[0] - gap, 0) : test[-1] + gap + 1] = False
        z = scaled(x, x[train] if per_fold else x)
        w, b = discriminant(z[train], y[train], priors, diagonal)
        out[test] = 1 / (1 + np.exp(-(z[test] @ w + b)))
    return out


def test_discriminants(rows):
    settings = {"m1_m8_lda": {"folds": 100}, "m17_predictions": {"folds": 10}, "m2_m9_lda_uniform": {"folds": 5, "gap": 1, "per_fold": True, "priors": [0.5, 0.5], "diagonal": True}}
    for name, how in settings.items():
        assert len(rows(name)) == 500
        for k in (0, 3):
            ids, x, y = subject(rows, k)
            g = rows(name).query("subject == @k").sort_values("vec_id")
            assert (g.vec_id == ids).all() and (g.truth == y).all()
            assert np.allclose(g.score, expected_scores(x, y, **how), atol=1e-6), name
    assert (rows("m17_predictions").predicted == (rows("m17_predictions").score >= 0.5)).all()


def area(y, s):
    a, b = s[y == 1][:, None], s[y == 0][None]
    return ((a > b) + 0.5 * (a == b)).mean()


def test_transfer_and_permutations(rows):
    held = rows("m10_hold_out")
    assert held.permutation.nunique() == PERMUTATIONS + 1
    for k in (0, 4):
        _, x, y = subject(rows, k)
        w, b = discriminant(scaled(x[:70], x[:70]), y[:70])
        s = 1 / (1 + np.exp(-(scaled(x[70:], x[:70]) @ w + b)))
        g = held.query("subject == @k and permutation == 0").sort_values("vec_id")
        assert np.allclose(g.score, s, atol=1e-6) and (g.truth == y[70:]).all()
        null = [area(h.truth.to_numpy(), h.score.to_numpy()) for p, h in held.query("subject == @k").groupby("permutation") if p]
        r = rows("k2_k3_null_table").query("subject == @k").iloc[0]
        assert abs(r.auc - area(y[70:], s)) < 1e-9 and abs(r.p - (sum(v >= r.auc for v in null) + 1) / (PERMUTATIONS + 1)) < 1e-9
        one = rows("k1_permutations").query("subject == @k").iloc[0]
        assert abs(one.auc - area(y, expected_scores(x, y, 10))) < 1e-9 and one.p < 0.05 and abs(one.p * (PERMUTATIONS + 1) - round(one.p * (PERMUTATIONS + 1))) < 1e-9
        swarm = rows("v6_swarm").query("subject == @k")
        assert len(swarm) == PERMUTATIONS + 1 and abs(swarm[swarm.is_model].auc.iloc[0] - area(y, expected_scores(x, y, 5))) < 1e-9
        assert abs(swarm[~swarm.is_model].auc.mean() - 0.5) < 0.1
        grid = rows("m12_grid").query("subject == @k").set_index("subset")
        assert abs(grid.auc["left"] - area(y, expected_scores(x[:, :32], y, 10))) < 1e-9
    _, a, y = subject(rows, 1)
    _, b, _ = subject(rows, 2)
    w, c = discriminant(scaled(a, a), y)
    g = rows("m11_transfer").query("subject == 1 and way == 'there'").sort_values("vec_id")
    assert np.allclose(g.score, 1 / (1 + np.exp(-(scaled(b, a) @ w + c))), atol=1e-6)


def test_region_grids_and_targets(rows):
    g = rows("m12_regions")
    assert g.groupby("subject").size().to_dict() == {0: 3, 1: 9, 2: 9, 3: 9, 4: 3}
    _, x, y = subject(rows, 1)
    own = g[g.subject == 1].set_index("subset")
    assert abs(own.auc["left acc"] - area(y, expected_scores(x[:, :6], y, 10))) < 1e-9 and abs(own.auc["bilateral acc"] - area(y, expected_scores(x[:, [*range(6), *range(12, 18)]], y, 10))) < 1e-9
    assert own.result["left acc"].startswith(f"{own.auc['left acc']:.2f} (p=")
    t = rows("m13_targets")
    assert len(t) == 5 * 2 * 2
    _, x, _ = subject(rows, 2)
    y = (x[:, 1] >= np.median(x[:, 1])) * 1.0
    assert abs(t.query("subject == 2 and side == 'right' and target == 'f1'").auc.iloc[0] - area(y, expected_scores(x[:, 32:], y, 5))) < 1e-9


def test_permuted_regressions(rows):
    """R2, correlation and their null values: Lasso of some permutations by slow coordinate descent, p-values by counting."""
    from tidepool.operators import models

    grid, whole = rows("m12_lasso_grid"), rows("k1_regressions")
    assert len(grid) == 15 and len(whole) == 5
    _, x, y = subject(rows, 1, score=True)

    def quality(x, y, folds):
        guess = np.zeros(len(y))
        for test in np.array_split(np.arange(len(y)), folds):
            keep = np.setdiff1d(np.arange(len(y)), test)
            z = scaled(x, x)
            w, b = lasso(z[keep], y[keep], 1e-4, 1500)
            guess[test] = z[test] @ w + b
        return 1 - ((y - guess) ** 2).sum() / ((y - y.mean()) ** 2).sum(), np.corrcoef(y, guess)[0, 1]

    own = grid[(grid.subject == 1) & (grid.subset == "left")].iloc[0]
    r2, rho = quality(x[:, :32], y, 10)
    assert abs(own.r2 - r2) < 1e-3 and abs(own.rho - rho) < 1e-3 and own.p_r2 == own.p_rho == 1 / (PERMUTATIONS + 1)
    right = grid[(grid.subject == 1) & (grid.subset == "right")].iloc[0]
    assert right.p_r2 > 0.02 and abs(right.p_rho * (PERMUTATIONS + 1) - round(right.p_rho * (PERMUTATIONS + 1))) < 1e-9
    parts = np.array_split(np.arange(100), 10)
    truths = np.array([np.random.default_rng([0, perm]).permutation(y) for perm in (1, 2)])
    made = models._stacked_lassos(x[:, :32], truths, parts, 0, "global")
    for t, s in zip(truths, made, strict=True):
        r2, rho = quality(x[:, :32], t, 10)
        assert abs(models._quality(t, s)[0] - r2) < 5e-3 and abs(models._quality(t, s)[2] - rho) < 5e-3
    one = whole[whole.subject == 1].iloc[0]
    assert one.r2 > 0.9 and one.rho > 0.9 and one.p_r2 == 1 / (PERMUTATIONS + 1)


def test_left_out_without_fitting_anew(spark):
    """A group in one task, the same split over tasks, groups without a name, of one class and with too few rows; against fits of all but one row."""
    from tidepool.operators import models

    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5)) * [1, 10, 0.1, 1, 1] + [0, 1000, 0, 3, 0]
    x[:, 3] = 3.0
    y = (x[:, 0] + rng.normal(size=90) > 0) * 1.0
    table = [("a" if i < 60 else None, i, list(map(float, v)), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    table += [("one", 100 + i, [float(i)] * 5, 1.0) for i in range(4)] + [("few", 110, [1.0] * 5, 0.0), ("few", 111, [2.0] * 5, 1.0), ("a", 120, None, 1.0), ("a", 121, [0.0] * 5, None)]
    df = spark.createDataFrame(table, "g string, i long, x array<double>, y double").repartition(4)
    for model, how in (("lda", {}), ("lda_uniform", {"priors": [0.5, 0.5], "diagonal": True})):
        made = [models.left_out(df, ["g"], "x", "y", "i", model, limit).toPandas().sort_values("i") for limit in (1000, 7)]
        assert made[0].i.tolist() == made[1].i.tolist() == [r[1] for r in table if r[1] < 120]
        assert np.allclose(made[0].score, made[1].score, atol=1e-9, equal_nan=True)
        assert made[1].score[made[1].i >= 100].isna().all()
        for lo, hi in ((0, 60), (60, 90)):
            z, expected = x[lo:hi] - [0, 1000, 0, 3, 0], []
            for i in range(hi - lo):
                keep = np.arange(hi - lo) != i
                w, b = linmod.lda(z[keep], y[lo:hi][keep], "auto", how.get("priors"), "diagonal" if how else "identity")
                expected.append(1 / (1 + np.exp(-(z[i] @ w + b))))
            assert np.allclose(made[1].score[(made[1].i >= lo) & (made[1].i < hi)], expected, atol=1e-6)


def dense_spline(x, y, w, stiffness, points):
    """Slopes of the smoothing spline by a dense least squares fit of a natural spline's basis (truncated cubes)."""

    def basis(at, order):
        cube = lambda k: np.where(at > k, (at - k) ** 3 if order == 0 else 3 * (at - k) ** 2, 0.0)
        part = lambda k: (cube(k) - cube(x[-1])) / (x[-1] - k)
        return np.column_stack([np.full(len(at), 1.0 - order), at if order == 0 else np.ones(len(at)), *[part(k) - part(x[-2]) for k in x[:-2]]])

    def bends(at):
        cube = lambda k: np.where(at > k, 6 * (at - k), 0.0)
        part = lambda k: (cube(k) - cube(x[-1])) / (x[-1] - k)
        return np.column_stack([np.zeros(len(at)), np.zeros(len(at)), *[part(k) - part(x[-2]) for k in x[:-2]]])

    at, share = np.polynomial.legendre.leggauss(4)
    inner = (x[:-1, None] + np.diff(x)[:, None] * (at + 1) / 2).ravel()
    size = (np.diff(x)[:, None] * share / 2).ravel()
    b, d2 = basis(x, 0), bends(inner)
    left = np.concatenate([b * np.sqrt(w)[:, None], d2 * np.sqrt(stiffness * size)[:, None]])
    found = np.linalg.lstsq(left, np.concatenate([y * np.sqrt(w), np.zeros(len(inner))]), rcond=None)[0]
    return basis(points, 1) @ found


def test_spline_densities(rows, spark):
    from tidepool.functions.splines import smoothing_spline
    from tidepool.operators import agg

    rng = np.random.default_rng(31)
    x = np.sort(rng.uniform(0, 3, 25))
    y, w = np.cumsum(rng.uniform(0, 2, 25)), rng.integers(1, 4, 25).astype(float)
    for stiffness in (1e-4, 0.1, 10.0):
        assert np.allclose(smoothing_spline(x, y, w, stiffness)[1], dense_spline(x, y, w, stiffness, x), rtol=1e-4, atol=1e-5)
    given = duckdb.sql(f"select event_type, value from '{SF}/events.parquet' where value is not null").fetchall()
    for kind, g in rows("d14_spline").groupby("event_type"):
        v = np.sort([b for a, b in given if a == kind])
        at, counts = np.unique(v, return_counts=True)
        mean_rank = np.cumsum(counts) - (counts - 1) / 2
        slopes = smoothing_spline(at, mean_rank, counts.astype(float), np.diff(v).mean() ** 3 / 0.0006)[1]
        g = g.sort_values("x")
        assert np.allclose(g.x, at) and np.allclose(g.density, slopes * len(v) / np.trapezoid(slopes, at), rtol=1e-9)
    values = np.round(rng.normal(size=5000), 2)  # ties, and a knot for every 25th value
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("c", None)], "g string, v double").repartition(3)
    got = agg.spline_density(df, ["g"], "v", 200).toPandas().sort_values("x")
    picked = np.sort(values)[::25]
    at, counts = np.unique(picked, return_counts=True)
    ranks = np.array([np.mean(np.flatnonzero(picked == a) * 25 + 1) for a in at])
    slopes = smoothing_spline(at, ranks, counts.astype(float), np.diff(picked).mean() ** 3 / 0.0006)[1]
    own = got[got.g == "a"]
    assert np.allclose(own.x, at) and np.allclose(own.density, slopes * 5000 / np.trapezoid(slopes, at)) and got.density[got.g == "b"].isna().all() and "c" not in set(got.g)


def test_coefficients(rows):
    _, x, y = subject(rows, 2)
    z, keep = scaled(x, x), ~np.eye(100, dtype=bool)
    for name, fits in (("m16_coefficients", [discriminant(z[k], y[k])[0] for k in keep]), ("v7_heatmap", [lasso(z[k], y[k], 1e-4)[0] for k in keep[:1]])):
        means = np.abs(fits).mean(0)
        g = rows(name)[rows(name).subject == 2]
        got = g.set_index("name").scaled[[f"f{i}" for i in range(64)]].to_numpy() if name[0] == "m" else g[[f"f{i}" for i in range(64)]].to_numpy()[0]
        expected = 2 * (means - means.min()) / (means.max() - means.min()) - 1
        assert np.allclose(got, expected, atol=1e-6) if name[0] == "m" else np.corrcoef(got, expected)[0, 1] > 0.98


def lasso(x, y, alpha, steps=20_000):
    """By proximal gradient steps."""
    m, c = x.mean(0), y.mean()
    x, y = x - m, y - c
    gram, goal, w = x.T @ x / len(y), x.T @ y / len(y), np.zeros(x.shape[1])
    rate = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(steps):
        v = w - rate * (gram @ w - goal)
        w = np.sign(v) * np.maximum(np.abs(v) - rate * alpha, 0)
    return w, c - m @ w


def ridge(x, y, at, penalties):
    """Guesses by the dual form, for each penalty."""
    m, sd = x.mean(0), x.std(0, ddof=1)
    a, b = (x - m) / sd, (at - m) / sd
    return np.array([b @ a.T @ np.linalg.solve(a @ a.T + k * np.eye(len(a)), y - y.mean()) + y.mean() for k in penalties])


def penalty(x, y):
    grid, errors = 10 ** np.linspace(-4, 5, 100), []
    for test in np.array_split(np.arange(len(y)), 10):
        train = np.setdiff1d(np.arange(len(y)), test)
        errors.append(np.sqrt(((ridge(x[train], y[train], x[test], grid) - y[test]) ** 2).mean(1)))
    mean, best = np.mean(errors, 0), np.mean(errors, 0).argmin()
    return grid[mean <= mean[best] + np.std(errors, 0, ddof=1)[best] / np.sqrt(10)][0]


def test_regressions(rows):
    _, x, y = subject(rows, 1, score=True)
    z = scaled(x, x)
    guess = np.zeros(100)
    for i in range(0, 100):
        keep = np.arange(100) != i
        w, b = lasso(z[keep], y[keep], 1e-4, 1500)
        guess[i] = z[i] @ w + b
    r = rows("m4_lasso").query("subject == 1").iloc[0]
    assert abs(r.rmse - np.sqrt(((y - guess) ** 2).mean())) < 0.01 and abs(r.r2 - (1 - ((y - guess) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 0.02
    g = rows("m7_ridge").query("subject == 1").sort_values("vec_id")
    guess = np.zeros(100)
    for test in np.array_split(np.arange(100), 3):
        train = np.setdiff1d(np.arange(100), test)
        guess[test] = ridge(z[train], y[train], z[test], [penalty(z[train], y[train])])[0]
    assert len(rows("m7_ridge")) == 500 and np.allclose(g.score, guess, atol=1e-6)
    for name in ("m5_logistic", "m6_svm", "m6_searched"):
        assert len(rows(name)) == 500 and np.mean([area(h.truth.to_numpy(), h.score.to_numpy()) for _, h in rows(name).groupby("subject")]) > 0.65, name
    both = rows("m18_acute_decoding")
    own = rows("m7_ridge").query("subject == 3")
    assert len(both) == 5 and abs(both.query("subject == 3").r2.iloc[0] - (1 - ((own.truth - own.score) ** 2).sum() / ((own.truth - own.truth.mean()) ** 2).sum())) < 1e-9


def tail(k, n, p):
    """P(X >= k)."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def test_limits_of_shares(rows, spark):
    def check(k, n, low, high):
        assert low == 0 if k == 0 else tail(k, n, max(low - 6e-4, 0)) <= 0.025 <= tail(k, n, low + 6e-4)
        assert high == 1 if k == n else 1 - tail(k + 1, n, min(high + 6e-4, 1)) <= 0.025 <= 1 - tail(k + 1, n, high - 6e-4)

    for r in rows("m14_limits").itertuples():
        check(r.tp, r.tp + r.fn, r.low, r.high)
    known = labelled(spark, SF).toPandas()
    for r in rows("m14_optimal").itertuples():
        g = known[known.user_id == r.user_id]
        best = max((round(((g.s >= t) & (g.y == 1)).sum() / (g.y == 1).sum() - ((g.s >= t) & (g.y == 0)).sum() / (g.y == 0).sum(), 12), t) for t in g.s.unique())[1]
        said = g.s >= best
        assert r.threshold == round(best, 3) and (r.tp, r.fp) == ((said & (g.y == 1)).sum(), (said & (g.y == 0)).sum())
        assert (r.tn, r.fn) == ((~said & (g.y == 0)).sum(), (~said & (g.y == 1)).sum()) and abs(r.accuracy - (r.tp + r.tn) / len(g)) < 6e-4
        for k, n, name in ((r.tp, r.tp + r.fn, "sensitivity"), (r.tn, r.tn + r.fp, "specificity"), (r.tp, r.tp + r.fp, "ppv"), (r.tp + r.tn, len(g), "accuracy")):
            check(int(k), int(n), getattr(r, f"{name}_low"), getattr(r, f"{name}_high"))


# Series, states, inference ----------------------------------------------------------------------


def test_states(rows, spark):
    """The whole order search; last states of recordings by matrix powers; areas and p-values of decoding by discriminants fitted one by one."""
    from tidepool.functions import ssm
    from tidepool.operators import statespace
    from tidepool.queries import HORIZON, ORDERS, state_series

    series = state_series(spark, SF)
    models = {r.subject: r for r in statespace.fitted(series, ["subject"], "i", "x", HORIZON, ORDERS).collect()}
    order = rows("j2_j7_fitted").set_index("subject")
    own = series.toPandas().sort_values(["subject", "i"])
    enough = {u for u, g in own.groupby("subject") if len(g) >= 2 * HORIZON * 3}
    assert set(order.index) == set(models) == enough and len(enough) >= 8 and order.n.between(1, 19).all() and np.isfinite(order.aic).all()
    last = {(r.subject, r.recording): (r.n, r.state) for r in rows("j6_j8_states").itertuples()}
    assert {u for u, _ in last} == enough
    decoded = rows("m19_state_decoding").set_index("subject")
    assert set(decoded.index) == enough and ((decoded.p > 0) & (decoded.p <= 1)).all()
    for user, g in own[own.subject.isin(enough)].groupby("subject"):
        a, c, k = (np.array(getattr(models[user], n)) for n in "ack")
        y = np.stack(g.x)
        y, step = (y - y.mean(0)) / y.std(0, ddof=1), a - k @ c
        x, scores = [], []
        for recording, z in g.assign(z=list(y)).groupby("recording").z:
            z = np.stack(z)
            state = sum((np.linalg.matrix_power(step, len(z) - 2 - t) @ k @ z[t] for t in range(len(z) - 1)), np.zeros(len(a)))
            n, found = last[user, recording]
            assert n == order.n[user] and np.allclose(found, state, atol=1e-6)
            x.append(state)
            scores.append(np.stack(g.x[g.recording == recording])[:, 0].mean())
        label, guess = (np.array(scores) >= np.median(scores)) * 1.0, np.full(len(scores), np.nan)
        x, whole = np.array(x), np.arange(len(scores))
        for i in whole:
            keep = np.abs(whole - i) > 4
            if keep.sum() >= 3 and len(set(label[keep])) == 2:
                w, b = linmod.lda(scaled(x, x)[keep], label[keep], "auto", (0.5, 0.5), "diagonal")
                guess[i] = 1 / (1 + np.exp(-(scaled(x, x)[i] @ w + b)))
        known = ~np.isnan(guess)
        expected = area(label[known], guess[known]) if len(set(label[known])) == 2 else np.nan
        assert (np.isnan(expected) and np.isnan(decoded.auc[user])) or abs(expected - decoded.auc[user]) < 1e-9
    y = np.stack(own[own.subject == min(enough)].x)
    y = (y - y.mean(0)) / y.std(0, ddof=1)
    values = []
    for n in range(1, 20):  # each order's model by itself
        a, c, k, _ = ssm.Subspace(y, HORIZON).fit(n)
        e = y - ssm.kalman(y, a, c, k)[1]
        values.append(len(y) * np.linalg.slogdet(e.T @ e / len(y))[1] + 2 * 5 * n)
    assert order.n[min(enough)] == np.nanargmin(values) + 1 and abs(order.aic[min(enough)] - np.nanmin(values)) < 1e-6


def test_models_with_inputs(rows):
    """The planted system's answer to an input, at every subject; the models of given values predict no worse than the mean."""
    found = rows("j2_planted")
    assert len(found) >= 14 and (found.n >= 1).all()
    assert np.abs(found[["at_once", "after_1", "after_2", "after_3"]].to_numpy() - [0.2, 0.5, 0.35, 0.245]).max() < 0.02
    given = rows("j2_inputs")
    assert len(given) >= 12 and set(given.subject) <= set(samples()) and given.n.between(1, 4).all() and np.isfinite(given.aic).all()
    for r in given.itertuples():
        assert np.shape(list(map(list, r.a))) == (r.n, r.n) and np.shape(list(map(list, r.b))) == (r.n, 1) and np.shape(list(map(list, r.d))) == (1, 1)


def test_planted_system_of_two_inputs_and_outputs():
    """Poles and answers of a planted system with noise, against the system itself."""
    from tidepool.functions import ssm

    rng = np.random.default_rng(21)
    a, b = np.array([[0.8, 0.3, 0.0], [-0.3, 0.8, 0.0], [0.0, 0.0, 0.5]]), rng.normal(size=(3, 2))
    c, d = rng.normal(size=(2, 3)), rng.normal(size=(2, 2))
    u, x, y = rng.normal(size=(4000, 2)), np.zeros(3), []
    for v in u:
        y.append(c @ x + d @ v + rng.normal(size=2) * 0.05)
        x = a @ x + b @ v + rng.normal(size=3) * 0.05
    y = np.array(y)
    made = ssm.InputSubspace(y, u, 8).fit(3)
    assert np.allclose(np.sort_complex(np.linalg.eigvals(made[0])), np.sort_complex(np.linalg.eigvals(a)), atol=0.01)
    assert np.allclose(made[3], d, atol=0.01)
    for power in range(6):
        assert np.allclose(made[2] @ np.linalg.matrix_power(made[0], power) @ made[1], c @ np.linalg.matrix_power(a, power) @ b, atol=0.02)
    error = y - ssm.predicted(y, u, *made)
    assert error[100:].std() < 0.12


def test_stable_models(rows):
    found = rows("j2_j3_stable")
    assert set(found.subject) == set(rows("j2_j7_fitted").subject) and found.n.between(1, 19).all() and np.isfinite(found.aic).all()
    for r in found.itertuples():
        a = np.array([list(row) for row in r.a])
        assert a.shape == (r.n, r.n) and np.abs(np.linalg.eigvals(a)).max() < 1 + 1e-9


def test_recordings_without_artifacts(rows):
    replaced = 0
    for r in rows("h16_without_artifacts").itertuples():
        x = samples()[r.user_id].copy()
        off = np.abs(x - np.median(x))
        good = off <= 3 * 1.4826 * np.median(off)
        at = np.flatnonzero(good)
        for i in np.flatnonzero(~good):
            before, after = at[at < i], at[at > i]
            a, b = before[-1] if len(before) else after[0], after[0] if len(after) else before[-1]
            x[i] = x[a] if a == b else samples()[r.user_id][a] + (samples()[r.user_id][b] - samples()[r.user_id][a]) * (i - a) / (b - a)
        replaced += (~good).sum()
        sos = dsp.butterworth(4, 6.0, 32.0, "lowpass")
        assert np.allclose(r.samples, both_ways(lambda v: one_way(sos, v), x, 6 * len(sos) + 3), atol=1e-6)  # noqa: B023
    assert replaced > 0


def test_kernels_over_bins(rows):
    events = duckdb.sql(f"select event_type, value from '{SF}/events.parquet'").df()
    found = rows("v2_bin_kernel")
    for kind, g in found.groupby("event_type"):
        v = np.sort(events.value[events.event_type == kind].to_numpy())
        q1, q3 = np.interp([len(v) * 0.25 + 0.5, len(v) * 0.75 + 0.5], np.arange(1, len(v) + 1), v)
        size = (v[-1] - v[0]) / round((v[-1] - v[0]) / (2 * (q3 - q1) / len(v) ** (1 / 3)))
        x = v[0] - size + np.arange(len(g)) * size / 3
        h = np.exp(-(((x[:, None] - v) / (size / 1.5)) ** 2) / 2).sum(1)
        g = g.sort_values("point")
        assert np.allclose(g.center, x, atol=1e-5) and abs(x[-1] - v[-1] - size) < 1e-6 and np.allclose(g.n, h / h.sum() * len(v), atol=1e-5)
        assert np.allclose(g.width0, h / h.max(), atol=1e-5)
    assert found[["width1", "width2", "width3"]].max().round(5).tolist() == [1, 1, 1]


def test_smooth_histograms(rows):
    events = duckdb.sql(f"select event_type, value from '{SF}/events.parquet' where value between 0 and 500").df()
    bend = np.diff(np.eye(101), 2, axis=0) * np.sqrt(10)
    for kind, g in rows("d14_smooth_histogram").groupby("event_type"):
        v = events.value[events.event_type == kind].to_numpy()
        share = np.array([(np.minimum(v // 5, 99) < i).mean() for i in range(101)])
        curve = np.linalg.lstsq(np.vstack([np.eye(101), bend]), np.append(share, np.zeros(99)), rcond=None)[0]
        assert np.allclose(g.sort_values("x").density, np.maximum(np.diff(curve) / 5, 0), atol=1e-9)


def test_surrogates(rows):
    events = duckdb.sql(f"select user_id, event_type, value from '{SF}/events.parquet'").df()
    for user, g in rows("k9_surrogates").groupby("user_id"):
        a, b = (events.value[(events.user_id == user) & (events.event_type == t)].to_numpy() for t in ("click", "view"))
        n = min(5, len(a), len(b))
        assert len(g) == SHUFFLES * n and set(g.shuffle) == set(range(SHUFFLES))
        pairs = np.sort(np.subtract.outer(a, b).ravel())
        near = pairs[np.clip(np.searchsorted(pairs, g["diff"]), 0, len(pairs) - 1)]
        before = pairs[np.clip(np.searchsorted(pairs, g["diff"]) - 1, 0, len(pairs) - 1)]
        assert np.minimum(np.abs(near - g["diff"]), np.abs(before - g["diff"])).max() < 1e-9
        assert g.groupby("shuffle")["diff"].mean().nunique() > 1
        assert abs(g["diff"].mean() - (np.mean(a) - np.mean(b))) < 0.2 * (np.std(a) + np.std(b))


def test_recordings(rows):
    got = rows("h20_recordings").set_index("user_id")
    ends = {u: v[:64] for u, v in samples().items()}
    gone = {sorted(u for u in ends if u // 5 == k)[j - 1] for k, j in ((1, 2), (2, 5)) if len([u for u in ends if u // 5 == k]) >= j}
    sd = {u: v.std(ddof=1) for u, v in ends.items() if u not in gone}
    for k in range(3):
        own = [u for u in sd if u // 5 == k]
        q1, q3 = np.percentile([sd[u] for u in own], [25, 75])
        kept = {u for u in own if q1 - 10 * (q3 - q1) <= sd[u] <= q3 + 10 * (q3 - q1)}
        assert kept == set(got.index[got.subject == k])
        assert all(abs(got.sd[u] - sd[u]) < 1e-9 and got.end_us[u] == int((len(ends[u]) - 1) / 16 * 1e6) and (got.contact_1[u], got.contact_2[u]) == (3, 1) for u in kept)


def test_power_features(rows):
    for r in rows("h21_power_features").itertuples():
        for j, channel in enumerate((2 * r.pair, 2 * r.pair + 1)):
            if channel not in samples() or len(samples()[channel]) < 16 * (r.window + 1):
                continue
            y = samples()[channel]
            for sos in (dsp.butterworth(4, 1.0, 16.0, "highpass"), dsp.butterworth(4, (3.0, 7.0), 16.0, "bandstop")):
                y = both_ways(lambda v: one_way(sos, v), y, 6 * len(sos) + 3)  # noqa: B023
            f, s = dsp.adaptive_multitaper(y[16 * r.window : 16 * r.window + 16], 16.0, 1.25, 16)
            expected = [10 * np.log10(s[(f >= lo) & (f < hi)].mean()) for lo, hi in ((1, 4), (4, 8))]
            assert np.allclose(r.features[2 * j : 2 * j + 2], expected, atol=1e-3) and r.ends == (16 * (r.window + 1) - 1) / 16


def test_synced_temperature(rows):
    events = duckdb.sql(f"select user_id, epoch_us(ts) t, event_type, value from '{SF}/events.parquet' order by 1, 2").df()
    sos, expected = dsp.butterworth(4, 0.5, 16.0, "lowpass"), {}
    for user, g in events.groupby("user_id"):
        t, v = g.t.to_numpy(), both_ways(lambda x: one_way(sos, x), g.value.to_numpy(), 6 * len(sos) + 3)
        for at in t[g.event_type == "view"]:
            expected[user, at] = (at, v[np.flatnonzero(t == at)[0]])  # its own time is the first from it on
    got = {(r.user_id, r.t): (r.match_t, r.match) for r in rows("h22_synced_temperature").itertuples()}
    assert got.keys() == expected.keys() and all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-6 for k, v in expected.items())


def test_compared_bouts(rows):
    found = {}
    for user, x in samples().items():
        for trial in range(-(-len(x) // 12)):
            part = x[trial * 12 : trial * 12 + 12]
            up = part > part.mean()
            starts = [i for i in range(len(up)) if up[i] and (i == 0 or not up[i - 1])]
            lengths = [next((j for j in range(s, len(up)) if not up[j]), len(up) - 1) - s for s in starts]
            y = (user * 1000 + trial) % 2
            for m, v in (("rate", len(starts) / 30), ("mean_duration", np.mean(lengths) if lengths else None), ("percent", 100 * sum(lengths) / len(part))):
                if v is not None:
                    found.setdefault((user, m), []).append((v, y))
    got = {(r.subject, r.measure): r for r in rows("k11_compared_bouts").itertuples()}
    for key, values in found.items():
        v, y = np.array(values).T
        if not 0 < y.sum() < len(y):
            continue
        rank = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        n1, n0, n = y.sum(), (1 - y).sum(), len(y)
        ties = sum((v == a).sum() ** 3 - (v == a).sum() for a in np.unique(v))
        spread = math.sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1))))
        d = rank[y == 1].sum() - n1 * (n + 1) / 2
        if spread > 0:
            z = (d - 0.5 * np.sign(d)) / spread
            assert abs(got[key].z - z) < 1e-6 and abs(got[key].p - math.erfc(abs(z) / math.sqrt(2))) < 1e-9, key
    for m in ("rate", "mean_duration", "percent"):
        own = sorted((r.p, r.adjusted) for k, r in got.items() if k[1] == m and r.p == r.p)
        for i, (p, adjusted) in enumerate(own):
            assert abs(adjusted - min(1, min(q * len(own) / (j + 1) for j, (q, _) in enumerate(own) if j >= i))) < 1e-9
