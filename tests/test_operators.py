"""Operators that SQL can't express, against NumPy, and small literal cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import dsp, ssm
from tidepool.functions.features import FeatureSet, feature_names, feature_sets
from tidepool.operators import agg, inference, models, plotdata, select, series, sets, spectral
from tidepool.queries import QUERIES, recordings
from tidepool.sources import readers, writers

SF = "/root/testdata/sf0.001"


def test_skip_sums(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0), (0, None, 9.0), (1, 4.0, 1.0), (1, 5.0, 0.0)], "g int, x double, w double")
    got = {r.g: (r.total, r.n) for r in agg.skip_sums(rows, ["g"], "x").collect()}
    assert got == {0: (1.0, 1), 1: (9.0, 2)}
    weighted = agg.skip_sums(rows.withColumn("g", F.lit(0)), ["g"], "x", "w").first()
    assert (weighted.total, weighted.n) == (6.0, 3.0)


def test_violins(spark):
    rows = [("d", float(v)) for v in (1, 1, 1, 1, 1, 2, 2, 2, 5, 5)] + [("one", 3.0)] * 4 + [("gone", None)] + [("c", i * 1.5) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, x double")
    auto = plotdata.violins(df, ["g"], "x", "auto")
    got = {}
    for r in plotdata.violin_widths(auto, ["g"], {"own": 0, "counts": 1, "equal": 3}).orderBy("g", "point").collect():
        got.setdefault(r.g, []).append(r)
    assert sorted(got) == ["c", "d", "one"]
    assert [(r.center, r.n, r.step) for r in got["c"]] == [(2.75, 4.0, 5.5), (8.25, 4.0, 5.5), (13.75, 4.0, 5.5)]
    assert [(r.center, r.n) for r in got["one"]] == [(3.0, 4.0)]
    assert [(r.n, r.own) for r in got["c"]] == [(4.0, 1.0)] * 3 and got["one"][0].counts == 4 / max(r.n for g in got.values() for r in g)
    repeated = df.where("g = 'd'").unionByName(df.where("g = 'd'"))  # 3 of 20 values are distinct: one bar each
    bars = plotdata.violins(repeated, ["g"], "x", "auto").orderBy("point").collect()
    assert [(r.point, r.center, r.n, r.step) for r in bars] == [(0, 1.0, 10.0, 1.0), (1, 2.0, 6.0, 1.0), (2, 5.0, 4.0, 1.0)]
    for kind in ("even", "auto", "kernel", "bin_kernel"):
        found = plotdata.violins(df, ["g"], "x", kind).groupBy("g").agg(F.sum("n").alias("n")).collect()
        assert {r.g: round(r.n, 6) for r in found} == {"c": 12, "d": 10, "one": 4}, kind
        assert plotdata.violins(df.where("false"), ["g"], "x", kind).isEmpty()
    with pytest.raises(ValueError):
        plotdata.violins(df, ["g"], "x", "other")


def test_artifacts_become_lines(spark):
    rows = [(0, [1.0, 2.0, 1.0, 90.0, 80.0, 2.0, 1.0, 2.0, 1.0]), (1, [50.0, 1.0, None, 2.0, 1.0, 2.0]), (2, []), (3, None), (4, [None]), (5, [1.0, 1.0, 1.0, 9.0])]
    got = {r.i: r.x for r in spectral.without_artifacts(spark.createDataFrame(rows, "i int, x array<double>"), ["i"], "x", 5.0).collect()}
    assert np.allclose(got[0], [1, 2, 1, 4 / 3, 5 / 3, 2, 1, 2, 1])
    assert got[1][:2] == [1.0, 1.0] and got[1][2] is None and got[1][3:] == [2.0, 1.0, 2.0]
    assert got[2] == [] and got[3] is None and len(got[4]) == 1 and got[5] == [1.0, 1.0, 1.0, 9.0]


def test_median_splits(spark):
    for values, expected in (([1, 2, 3, 4], [0, 0, 1, 1]), ([0, 0, 0, 5], [1, 1, 1, 1]), ([3, 3, 3, 3], [1, 1, 1, 1])):
        rows = spark.createDataFrame([(0, float(v), i) for i, v in enumerate(values)], "g int, x double, i int")
        assert [r.y for r in agg.median_split(rows, ["g"], "x", "y").orderBy("i").collect()] == expected


def test_folds_entries_and_repetition(spark):
    ten = spark.range(10).withColumn("g", F.lit(0))
    assert sorted(r["count"] for r in series.k_folds(ten, ["g"], ["id"], 4).groupBy("fold").count().collect()) == [2, 2, 3, 3]
    m = spark.createDataFrame([(v,) for v in (11, 11, 22, 33, 33, 22, 22, 22, 44, 11)], "v int").withColumn("g", F.lit(0))
    assert [(r.v, r.n) for r in agg.entries(m, ["g"], "v").orderBy("rank").collect()] == [(11, 3), (22, 4), (33, 2), (44, 1)]
    k = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 0)], "v int, k int")
    assert sorted(r.v for r in sets.repeated(k, "k").collect()) == [1, 1, 2, 2, 2, 3, 4]


def test_feature_sets():
    names = [*feature_names(), "leftcohdelta", "nrs"]
    assert [len(s.columns(names)) for s in feature_sets()] == [24, 12, 12, 12, 12, 6, 6, 6, 6]
    assert FeatureSet("x", "left", "acc").columns(names)[0] == "leftaccdelta" and len(feature_sets(("right",))) == 3


def test_exclusion_keeps_unknown(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (None,)], "x double")
    assert [r.x for r in select.excluding(rows, F.col("x") == 0).collect()] == [1.0, None]


def test_smooth_histogram_is_a_density(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(0, float(v)) for v in rng.normal(50, 10, 2000)], "g int, x double")
    got = agg.smooth_histogram(df, ["g"], "x", 0.0, 100.0).orderBy("x").collect()
    assert sum(r.density for r in got) == pytest.approx(1, abs=0.02) and abs(max(got, key=lambda r: r.density).x - 50) < 4


def _pchip(x, y, at):
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (w0 + w1) / (w0 / d[i - 1] + w1 / d[i])

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = (end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])) if len(x) > 2 else (d[0], d[0])
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    t = (at - x[i]) / h[i]
    return (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h[i] * m[i] + t * t * (3 - 2 * t) * y[i + 1] + t * t * (t - 1) * h[i] * m[i + 1]


def test_resampling(spark):
    rng = np.random.default_rng(0)
    for n in (2, 3, 12):
        x = np.cumsum(rng.integers(3, 40, n)).astype(int)
        y = rng.normal(size=n)
        rows = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(x, y, strict=True)], "g int, t long, v double")
        got = sorted((r.t, r.value) for r in series.resampled(rows, ["g"], "t", "v", 7).collect())
        grid = np.arange(x[0], x[-1] + 1, 7)
        assert [t for t, _ in got] == grid.tolist()
        assert np.allclose([v for _, v in got], _pchip(x.astype(float), y, grid.astype(float)))


def test_partial_autocorrelation(spark):
    rng = np.random.default_rng(1)
    x = np.zeros(600)
    for i in range(2, 600):
        x[i] = 0.5 * x[i - 1] - 0.3 * x[i - 2] + rng.normal()
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "g int, i int, v double")
    a = series.autocovariance(rows, ["g"], "i", "v", 5)
    got = {r.lag: r.pacf for r in series.partial_autocorrelation(a, ["g"], 600).collect()}
    c = x - x.mean()
    acov = np.array([(c[k:] * c[: len(c) - k]).sum() / len(c) for k in range(6)])
    for k in range(1, 6):
        matrix = acov[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert got[k] == pytest.approx(np.linalg.solve(matrix, acov[1 : k + 1])[-1], abs=1e-8)


def test_spectrogram_and_band_powers(spark):
    fs = 64.0
    x = np.sin(2 * np.pi * 10 * np.arange(256) / fs)
    rows = spark.createDataFrame([(1, x.tolist()), (2, None), (3, [])], "id int, samples array<double>")
    for method in ("mt", "welch", "wavelet"):
        s = spectral.spectrogram(rows, ["id"], "samples", fs, method, 1.0, 0.5, (1.0, 30.0)).groupBy("id", "f").agg(F.avg("power").alias("p"))
        best = s.orderBy(F.desc("p")).first()
        assert best.id == 1 and abs(best.f - 10) <= 2, method
    s = spectral.spectrogram(rows, ["id"], "samples", fs, "hilbert", step=0.5, bands=((8, 12), (20, 25))).groupBy("f").agg(F.avg("power").alias("p"))
    power = {r.f: r.p for r in s.collect()}
    assert power[10.0] == pytest.approx(1, abs=0.3) and power[22.5] < 0.1
    db = {(r.window, r.band): r.db for r in spectral.band_powers(rows, ["id"], "samples", fs, {"in": (8, 12), "out": (20, 25)}).collect()}
    assert len(db) == 8 and db[0, "in"] > db[0, "out"] + 20


def test_permutations_are_reproducible_and_near_chance(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, rng.normal(size=3).tolist(), int(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, i int, x array<double>, y int")
    one = models.cross_validated(df, ["g"], "x", "y", "i", "lda", folds=5, permutations=20).collect()
    other = models.cross_validated(df.repartition(7), ["g"], "x", "y", "i", "lda", folds=5, permutations=20).collect()
    key = lambda r: (r.permutation, r.i)
    assert sorted(one, key=key) == sorted(other, key=key)
    areas = agg.auc(spark.createDataFrame(one), ["permutation"], "truth", "score").agg(F.avg("auc")).first()[0]
    assert abs(areas - 0.5) < 0.12


def test_auc_of_negated_scores(spark):
    rows = spark.createDataFrame([(0, i % 2, float((i * 7) % 5)) for i in range(40)], "g int, y int, s double")
    a, b = (agg.auc(d, ["g"], "y", "s").first().auc for d in (rows, rows.withColumn("s", -F.col("s"))))
    assert a + b == pytest.approx(1)


def test_fdr_is_monotone_and_grid_agrees(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame([(0, v) for v in p], "g int, p double")
    a = [r.adjusted for r in inference.fdr_adjusted(df, ["g"], "p").orderBy("p").collect()]
    assert a == sorted(a) and a[0] == pytest.approx(0.01) and a[1] == pytest.approx(0.04)
    grid = 10 ** np.linspace(-6, -1, 1000)
    for r in inference.fdr_grid(df, ["g"], "p").collect():
        passing = [q for q in grid if any(v <= (i + 1) / 10 * q and r.p <= v for i, v in enumerate(p))]
        assert r.q == pytest.approx(min(passing) if passing else 1.0, rel=1e-6)


def test_streams_equal_batches(spark):
    sos = dsp.butterworth(2, 2.0, 16.0, "lowpass")
    got = {(r.user_id, r.t): r.value for r in QUERIES["t1_filter_stream"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value").collect()
    assert len(got) == len({(r.user_id, r.t) for r in rows})
    user = rows[0].user_id
    own = sorted((r.t, r.value) for r in rows if r.user_id == user)
    expected, _ = dsp.filter_sections(sos, np.array([v for _, v in own]))
    assert np.allclose([got[user, t] for t, _ in own], expected)


def test_outlines_deal_a_large_group_to_many_tasks(spark):
    """A group's values are joined with its statistics in parts, not in a task each; medians take counts of values."""
    df = spark.range(4000).select(F.lit("a").alias("g"), (F.col("id") % 500).cast("double").alias("x"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = agg.joined_in_parts(df, df.groupBy("g").agg(F.max("x").alias("top")), ["g"], "x")
        assert rows.where("top = 499").count() == 4000 and rows.select(F.spark_partition_id()).distinct().count() == 4
        for kind in ("even", "auto", "kernel", "bin_kernel"):
            plan = plotdata.violins(df, ["g"], "x", kind)._jdf.queryExecution().executedPlan().toString()
            assert "_part#" in plan, kind
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    counts = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 9.0, 2)], "g string, v double, c int")
    assert agg.percentiles(counts, ["g"], "v", {"m": 0.5, "q": 0.75}, weight="c").first()[1:] == (1.5, 7.25)


@pytest.mark.parametrize("rounds", [0, 1, 2, 3])
def test_selection_of_hot_groups(spark, rounds):
    """Percentiles by rounds of selection: a group with most rows, heavy ties, huge ranges, one value, nulls; as NumPy's."""
    rng = np.random.default_rng(15)
    data = {"hot": np.round(rng.normal(size=6000) * 1e3) / 7, "ties": rng.choice([1.0, 2.0, 2.5], 900), "wide": 10.0 ** rng.uniform(-300, 300, 500), "one": np.array([3.0]), "two": np.array([-1.0, 4.0])}
    rows = [(g, float(v)) for g, own in data.items() for v in own] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.0, "q1": 0.25, "med": 0.5, "p99": 0.99, "most": 1.0}
    got = {r.g: r for r in agg.percentiles(df, ["g"], "v", shares, rounds=rounds).collect()}
    assert set(got) == set(data)
    for g, own in data.items():
        assert np.allclose([got[g][n] for n in shares], np.quantile(own, list(shares.values())), rtol=1e-12), g
    whole = agg.percentiles(df, [], "v", shares, rounds=rounds).first()
    assert np.allclose([whole[n] for n in shares], np.quantile(np.concatenate(list(data.values())), list(shares.values())), rtol=1e-12)


def test_selection_sorts_no_group(spark):
    """With rounds, windows are over ranges of a group or over counts of its ranges; the estimate of the input decides whether there are any."""
    df = spark.range(20_000).selectExpr("'g' g", "cast(hash(id) as double) v")
    plan = agg.percentiles(df, ["g"], "v", {"m": 0.5}, rounds=2)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [sum" in line]
    assert windows and all("_s" in line or "_r1" in line for line in windows)
    kept = agg._narrowed(df.groupBy("g", "v").agg(F.count("*").alias("_k")).withColumn("_base", F.lit(0).cast("long")), ["g"], ["g"], "v", spark.createDataFrame([("g", [9999, 10000])], "g string, _places array<long>"), 0)
    assert kept.count() < 3 * 20_000 / agg.SELECT_RANGES
    assert agg._estimated_bytes(df) < agg.SELECT_BYTES < agg._estimated_bytes(spark.range(10**9))


@pytest.mark.parametrize("mode", ["biased", "unbiased", "coeff"])
def test_autocovariance_by_blocks(spark, mode):
    """One series in many blocks, lags longer than a block, missing values, and a short series; as by windows."""
    rng = np.random.default_rng(17)
    rows = [("long", 3 * k, None if k % 11 == 4 else float(v)) for k, v in enumerate(rng.normal(size=500) + 100)] + [("short", k, float(k)) for k in range(3)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(4)
    whole = {(r.g, r.lag): (r.acov, r.n) for r in series.autocovariance(df, ["g"], "i", "v", 40, mode).collect()}
    got = {(r.g, r.lag): (r.acov, r.n) for r in series.autocovariance_by_blocks(df, ["g"], "i", "v", 40, mode, block=32).collect()}
    assert got.keys() == whole.keys()
    for key, (acov, n) in whole.items():
        assert got[key][1] == n and (got[key][0] is None if acov is None else abs(got[key][0] - acov) < 1e-9), key


def _run_in_chunks(spark, folder, chunks, late, make):
    """What a stream over one file of (channel, t, value) rows after another gives, once its watermark has passed them all."""
    schema = "ts timestamp, channel long, t long, value double"
    for n, rows in enumerate(chunks):
        made = spark.createDataFrame(rows, "channel long, t long, value double").coalesce(1).withColumn("ts", F.timestamp_micros("t"))
        made.select("ts", "channel", "t", "value").write.parquet(f"{folder}/rows-{n}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/rows-*")
    out = make(files, late)
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def test_streams_use_rows_that_are_late_within_the_delay(spark, tmp_path):
    """Rows shuffled over chunks give what they give in order; a row beyond the delay is dropped, rows of no channel aren't used."""
    from tidepool.streaming import stateful

    sos, second = dsp.butterworth(2, 2.0, 16.0, "lowpass"), 1_000_000
    rng = np.random.default_rng(7)
    rows = [(c, i * second + 100 * c + 7, float(rng.normal())) for i in range(60) for c in (1, 2)]
    order = np.argsort([r[1] + rng.uniform(0, 8 * second) for r in rows], kind="stable")  # late by up to 8 seconds
    chunks = [[rows[j] for j in part] for part in np.array_split(order, 5)]
    chunks[4].append((1, 5 * second + 1, 1000.0))  # its turn is over
    chunks[2].append((None, 30 * second, 1.0))
    chunks.append([(None, 100 * second, None)])
    a, c, k = np.array([[0.9]]), np.array([[1.0]]), np.array([[0.3]])
    made = {
        "filter": lambda df, late: stateful.filter_stream(df, "channel", "t", "value", sos, late),
        "kalman": lambda df, late: stateful.kalman_stream(df.withColumn("value", F.array("value")), "channel", "t", "value", a, c, k, late),
    }
    for name, make in made.items():
        (tmp_path / name).mkdir()
        got = _run_in_chunks(spark, str(tmp_path / name), chunks, "9 seconds", make)
        assert len(got) == len(rows)
        for channel in (1, 2):
            own = [r for r in rows if r[0] == channel]
            values = np.array([r[2] for r in own])
            expected = dsp.filter_sections(sos, values)[0] if name == "filter" else ssm.kalman(values[:, None], a, c, k)[0][:, 0]
            found = {r.t: r[2] for r in got if r.channel == channel}
            assert np.allclose([np.ravel(found[r[1]])[0] for r in own], expected), name


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"time": "2020-01-01 10:00:00", "x": 1.5, "nrs": NaN}, {"time": "", "x": 2.0, "nrs": 3.0}, {"time": "2020-01-02 00:00:00", "x": null, "nrs": 4.0}]')
    t = readers.read_timetable(spark, str(tmp_path / "a.json"), "x double, nrs double, time string", "time", ["x"], ["nrs"])
    assert t.columns == ["time", "nrs", "x"] and [(r.nrs, r.x) for r in t.collect()] == [(None, 1.5)]
    writers.write_csv(t, str(tmp_path / "csv"), single=True)
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 1
    df = readers.linear_data(spark, 200, [1.0, 2.0], 0.0)
    assert all(math.isclose(r.y, r.x[0] + 2 * r.x[1]) for r in df.collect())


def test_recordings_plan_needs_no_join(spark):
    plan = recordings(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_surrogates_are_dealt_out(spark, monkeypatch):
    """Few bytes of rows still go to many tasks; a long series is drawn from in parts; subsets are even, without repeats and in order."""
    rows = spark.createDataFrame([(u, float(v) if v < 40 else None, None if v < 40 else 0.0) for u in range(6) for v in range(50)], "u long, a double, b double")
    monkeypatch.setattr(inference, "DRAWN", 4000)
    made = inference.surrogate_differences(rows, ["u"], "a", "b", 1500, 5)
    assert made.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    got = made.toPandas()
    assert len(got) == 6 * 1500 * 5 and (got.groupby(["u", "shuffle"])["diff"].nunique() == 5).all()
    assert got.sort_values(["u", "shuffle", "i"]).groupby(["u", "shuffle"])["diff"].is_monotonic_increasing.all()
    share = got["diff"].value_counts() / (6 * 1500 * 5)
    assert len(share) == 40 and share.between(0.02, 0.03).all()


def test_blocks_of_short_series(spark):
    """Series shorter than the lags, and a block's tasks: lags beyond a series have no products; few bytes go to many tasks."""
    rows = spark.createDataFrame([(u, i, float((i * 7 + u) % 5)) for u in range(3) for i in range(4 + u)], "u long, i long, v double")
    got = {(r.u, r.lag): r.acov for r in series.autocovariance_by_blocks(rows, ["u"], "i", "v", 5).collect()}
    plain = {(r.u, r.lag): r.acov for r in series.autocovariance(rows, ["u"], "i", "v", 5).collect()}
    for key, value in got.items():
        assert value is None if plain.get(key) is None else abs(value - plain[key]) < 1e-9, key
    made = series.autocovariance_by_blocks(rows, ["u"], "i", "v", 5)
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()


def test_coefficients_of_all_folds_together(spark):
    """Lasso coefficients of folds that are solved at once equal each fold's own; groups go to many tasks though they are few bytes."""
    from tidepool.functions import linmod

    rng = np.random.default_rng(2)
    m = rng.normal(size=(70, 4))
    t = (m[:, 0] + rng.normal(size=70) > 0).astype(int)
    rows = spark.createDataFrame([(0, i, [float(v) for v in m[i]], int(t[i])) for i in range(70)], "g int, i int, x array<double>, y int")
    made = models.coefficients(rows, ["g"], "x", "y", "i", list("abcd"), "lasso")
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
    got = made.toPandas().pivot(index="fold", columns="name", values="coefficient").to_numpy()
    z = (m - m.mean(0)) / m.std(0)
    assert np.allclose(got, [linmod.lasso(np.delete(z, i, 0), np.delete(t, i).astype(float), 1e-4)[0] for i in range(70)], atol=1e-9)


def test_areas_of_a_transfer_leave_one_row_for_a_permutation(spark):
    """They are those of its scores; a group whose other table has one class has none."""
    rows = spark.range(60).selectExpr("id % 3 g", "id i", "array(sin(id), cos(id * id), id % 7 / 1e0) x", "cast(id % 2 as int) y")
    train, test = rows.where("i < 36"), rows.where("i >= 36 and (g < 2 or y = 1)")
    areas = models.transfer_areas(train, test, ["g"], "x", "y", "i", permutations=230)
    scored = models.transfer(train, test, ["g"], "x", "y", "i", permutations=230)
    assert areas.count() == 3 * 231 and areas.where("auc is null").select("g").distinct().collect() == [(2,)]
    both = areas.join(agg.auc(scored, ["g", "permutation"], "truth", "score").withColumnRenamed("auc", "there"), ["g", "permutation"])
    assert both.count() == 3 * 231 and both.where("not auc <=> there").isEmpty()


def test_swarm_makes_its_models_once(spark):
    """The query's plan fits its models in one place, and marks permutation 0."""
    plan = QUERIES["v6_swarm"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1
    areas = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.5), (1, 2, 0.4)], "g long, permutation int, auc double")
    other = plotdata.swarm(areas.where("permutation > 0"), areas.where("permutation = 0"), ["g"], "auc")
    assert sorted(plotdata.swarm_among(areas, ["g"], "auc").collect()) == sorted(other.collect())


def test_statistics_of_permutations_taken_together(spark):
    """Number 0 has no batch of its own at the end; R2 and correlation of all permutations at once equal those of each one's scores, also where some rows or all have none."""
    assert [r._batch for r in models._batched(spark.range(1), 1000, 200).orderBy("_batch").collect()] == [0, 1, 2, 3, 4]
    for permutations in (0, 1, 199, 200, 201, 1000):
        batches = [r._batch for r in models._batched(spark.range(1), permutations, 200).orderBy("_batch").collect()]
        assert np.concatenate([models._numbers(b, permutations, 200) for b in batches]).tolist() == list(range(permutations + 1))
    rng = np.random.default_rng(5)
    rows = [(g, i, [float(v) for v in rng.normal(size=4)], float(rng.normal()) if g else 2.0) for g in range(2) for i in range(24)]
    rows += [(2, i, [float(i), 1.0, float(i % 2), 0.0], 1.0 if i < 6 else 0.0) for i in range(7)] + [(1, 99, None, 1.0), (1, 98, [1.0] * 4, None)]
    df = spark.createDataFrame(rows, "g int, i int, x array<double>, y double")
    found = models.statistics(df.repartition(5), ["g"], "x", "y", "i", "lasso", "regression", folds=4, permutations=230).toPandas().set_index(["g", "permutation"])
    scored = models.cross_validated(df, ["g"], "x", "y", "i", "lasso", folds=4, permutations=230).toPandas()
    assert len(found) == 3 * 231 and found.loc[0].r2.isna().all() and scored[scored.g == 2].score.isna().any() and found.loc[2].rmse.notna().any()
    for key, own in scored.groupby(["g", "permutation"]):
        t, s = own.sort_values("i")[["truth", "score"]].dropna().to_numpy().T
        expected = (1 - ((t - s) ** 2).sum() / ((t - t.mean()) ** 2).sum(), np.sqrt(((t - s) ** 2).mean())) if len(t) and np.ptp(t) else (np.nan, np.sqrt(((t - s) ** 2).mean()) if len(t) else np.nan)
        assert np.allclose(found.loc[key, ["r2", "rmse"]].astype(float), expected, atol=1e-9, equal_nan=True), key
    t, s = rng.normal(size=(2, 3, 9))
    assert np.allclose(np.transpose(models._quality(t, s)), [models._quality(a, b) for a, b in zip(t, s, strict=True)], rtol=0, atol=0)
    assert np.allclose(models._quality(t, s)[2], [np.corrcoef(a, b)[0, 1] for a, b in zip(t, s, strict=True)])


def test_decoding_fits_models_once(spark):
    """Models aren't fitted again for the median; groups of few rows have the same areas from larger batches."""
    from tidepool.functions import linmod
    from tidepool.plans import analyses

    s = spark.range(400).selectExpr("id % 4 subject", "floor(id / 4) i", "array(double(xxhash64(id) % 100), double(xxhash64(id, 1) % 7)) x", "floor(id / 24) recording")
    score = s.groupBy("subject", "recording").agg(F.avg(F.col("x")[0]).alias("y"))
    decoded = analyses.state_decoding(s, "subject", "recording", "i", "x", score, "y", 5, range(1, 4), permutations=300)
    assert decoded._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == 2
    rows = decoded.toPandas()
    assert len(rows) == 4 and rows.p.between(0, 1).all()
    data = spark.range(60).selectExpr("if(id < 20, 0, 1) g", "id", "array(double(xxhash64(id) % 100)) x", "int(xxhash64(id, 2) % 2 = 0) y")
    assert {r._batch for r in models._batched_by_rows(data, ["g"], 1000, "lda").where("g = 0").collect()} == {0}
    assert {r._batch for r in models._batched_by_rows(data, ["g"], 1000, "lda").where("g = 1").collect()} == {0, 1, 2, 3, 4}
    areas = models.statistics(data, ["g"], "x", "y", "id", "lda_uniform", gap=1, permutations=450).toPandas()
    assert sorted(areas.permutation) == sorted([*range(451)] * 2)
    slow = models.cross_validated(data, ["g"], "x", "y", "id", "lda_uniform", gap=1, permutations=450).toPandas()
    one = areas.set_index(["g", "permutation"]).auc
    for key, g in slow[slow.permutation.isin([0, 3, 199, 200, 201, 450])].dropna().groupby(["g", "permutation"]):
        assert abs(one[key] - linmod.auc(g.truth.to_numpy(), g.score.to_numpy())) < 1e-12
