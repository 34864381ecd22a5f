"""Spectra, band powers and filters of recordings that are arrays of samples, one row each."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import dsp
from tidepool.functions.columns import closed_band, decibel
from tidepool.functions.quantiles import chi2_quantile, t_quantile
from tidepool.operators import agg

#: The filters of acute recordings (kind, Hz, order); one comes twice.
ACUTE_FILTERS = (
    ("bandstop", 66.0, 70.0, 4),
    ("bandstop", 81.0, 85.0, 4),
    ("bandstop", 103.0, 107.0, 4),
    ("bandstop", 103.0, 107.0, 4),
    ("bandstop", 126.0, 130.0, 4),
    ("highpass", 1.0, None, 4),
)


def _by_row(df: DataFrame, key: Sequence[str], samples: str, made: Callable[[np.ndarray], Mapping[str, np.ndarray]], schema: str) -> DataFrame:
    """Long rows that each recording's samples are made into."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                x = np.asarray(row[-1], float) if row[-1] is not None else np.zeros(0)
                if len(x):
                    out = pd.DataFrame(made(x))
                    yield pd.concat([pd.DataFrame({k: [v] * len(out) for k, v in zip(key, row[:-1], strict=True)}), out], axis=1)

    return df.select(*key, samples).mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in key], schema]))


def spectrogram(
    df: DataFrame, key: Sequence[str], samples: str, fs: float, method: str = "mt", window: float = 1.0, step: float = 0.1, fpass: tuple[float, float] = (0.0, 100.0), bands: Sequence[tuple[float, float]] = ()
) -> DataFrame:
    """``t, f, power`` of every recording: multitaper (``mt``), ``welch``, ``wavelet``, or ``hilbert`` (one f for each band: its center)."""
    n, hop = round(window * fs), round(step * fs)

    def made(x: np.ndarray) -> Mapping[str, np.ndarray]:
        if method in ("mt", "welch"):
            if len(x) < n:
                return {"t": [], "f": [], "power": []}
            windows = np.lib.stride_tricks.sliding_window_view(x, n)[::hop]
            t = (np.arange(len(windows)) * hop + n / 2) / fs
            if method == "mt":
                f, s = dsp.multitaper(windows, fs, fpass=fpass)
            else:
                f = dsp.welch(windows[0], fs)[0]
                s = np.array([dsp.welch(w, fs)[1] for w in windows])
                inside = (f >= fpass[0]) & (f <= fpass[1])
                f, s = f[inside], s[:, inside]
        else:
            t = np.arange(0, len(x), hop) / fs
            if method == "wavelet":
                f = np.arange(max(1.0, fpass[0]), fpass[1] + 0.5)
                s = dsp.morlet_power(x, fs, f)[:, ::hop].T
            else:
                f = np.array([(a + b) / 2 for a, b in bands])
                s = np.array([dsp.envelope(dsp.fir_both_ways(dsp.fir(fs, a, b), x))[::hop] ** 2 for a, b in bands]).T
        return {"t": np.repeat(t, len(f)), "f": np.tile(f, len(t)), "power": s.ravel()}

    return _by_row(df, key, samples, made, "t double, f double, power double")


def spectrum(df: DataFrame, key: Sequence[str], samples: str, fs: float, nw: float = 3.0, k: int = 5, fpass: tuple[float, float] = (0.0, 100.0), error: str | None = None, p: float = 0.05, finite_size: bool = False) -> DataFrame:
    """``f, power, low, high``: a multitaper spectrum, with chi-square (``finite_size``: of fewer degrees for short series) or jackknife limits (else null)."""

    def made(x: np.ndarray) -> Mapping[str, np.ndarray]:
        f, s = dsp.multitaper(x, fs, nw, k, fpass)
        low = high = np.full(len(f), np.nan)
        if error == "chi2":
            dof = int(1 / (1 / (2 * k) + 1 / (2 * len(x)))) if finite_size else 2 * k
            low, high = dof * s / chi2_quantile(1 - p / 2, dof), dof * s / chi2_quantile(p / 2, dof)
        elif error == "jackknife":
            low, high = dsp.jackknife(x, fs, nw, k, fpass, t_quantile(1 - p / 2, k - 1))
        return {"f": f, "power": s, "low": low, "high": high}

    out = _by_row(df, key, samples, made, "f double, power double, low double, high double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("low", "high")})


def band_dimension(spark, bands: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``band, low, high``: some rows from the program."""
    return spark.createDataFrame([(b, float(lo), float(hi)) for b, (lo, hi) in bands.items()], "band string, low double, high double")


def band_means(spectra: DataFrame, key: Sequence[str], bands: Mapping[str, tuple[float, float]], f: str = "f", power: str = "power", closed: str = "right") -> DataFrame:
    """Mean power in each band, ``band`` in the rows; the first band of the figures' set includes its lower end."""
    hits = [F.when(closed_band(F.col(f), F.lit(float(lo)), F.lit(float(hi)), closed) | ((F.lit(i == 0)) & (F.col(f) == lo)), F.lit(b)) for i, (b, (lo, hi)) in enumerate(bands.items())]
    rows = spectra.withColumn("band", F.explode(F.array_compact(F.array(*hits))))
    return rows.groupBy(*key, "band").agg(F.avg(power).alias("power"))


def feature_columns(means: DataFrame, key: Sequence[str], side: str, region: str, names: Sequence[str], value: str = "power") -> DataFrame:
    """Band means as columns named side + region + band, in the given order."""
    rows = means.withColumn("_f", F.concat(side, region, "band"))
    return rows.groupBy(*key).pivot("_f", list(names)).agg(F.first(value))


def band_powers(df: DataFrame, key: Sequence[str], samples: str, fs: float, bands: Mapping[str, tuple[float, float]], window: float = 1.0, method: str = "multitaper") -> DataFrame:
    """``window, band, db``: decibels of the mean power in each band [low, high) of whole windows, by adaptive ``multitaper`` or ``welch`` (density x 2 pi)."""
    n, nw, nfft = round(window * fs), max(window, 1.25), max(dsp.fft_size(round(window * fs)), dsp.fft_size(int(np.ceil(fs))))

    def made(x: np.ndarray) -> Mapping[str, np.ndarray]:
        windows = x[: len(x) // n * n].reshape(-1, n)
        if not len(windows):
            return {"window": [], "band": [], "power": []}
        if method == "multitaper":
            f, s = dsp.adaptive_multitaper(windows, fs, nw, nfft)
        else:
            f, s = dsp.welch(windows[0], fs)[0], 2 * np.pi * np.array([dsp.welch(w, fs)[1] for w in windows])
        means = [s[:, (f >= lo) & (f < hi)].mean(1) if ((f >= lo) & (f < hi)).any() else np.full(len(s), np.nan) for lo, hi in bands.values()]
        return {"window": np.repeat(np.arange(len(windows)), len(bands)), "band": np.tile(list(bands), len(windows)), "power": np.array(means).T.ravel()}

    rows = _by_row(df, key, samples, made, "window int, band string, power double")
    return rows.select(*key, "window", "band", decibel(F.when(~F.isnan("power"), F.col("power"))).alias("db"))


def log_scaled(spectra: DataFrame, key: Sequence[str], z: bool = False, power: str = "power") -> DataFrame:
    """Powers as log10; ``z``: as z-scores of each recording's frequency over time."""
    rows = spectra.withColumn(power, F.log10(power))
    return agg.z_scores(rows, [*key, "f"], power, power) if z else rows


def between(df: DataFrame, samples: str, fs: float, start: float, stop: float) -> DataFrame:
    """Recordings from ``start`` to ``stop`` (seconds)."""
    return df.withColumn(samples, F.slice(samples, int(start * fs) + 1, max(int(stop * fs) - int(start * fs), 0)))


def trial_mean(spectra: DataFrame, key: Sequence[str], power: str = "power") -> DataFrame:
    """The mean of several recordings' spectrograms at each time and frequency."""
    return spectra.groupBy(*key, "t", "f").agg(F.avg(power).alias(power), F.count(power).alias("n"))


def acute_filters(spark) -> DataFrame:
    """``position, kind, low, high, order``: the fixed filters of acute recordings; some rows from the program."""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(ACUTE_FILTERS)], "position int, kind string, low double, high double, order int")


def acute_filtered(df: DataFrame, key: Sequence[str], samples: str, fs: float) -> DataFrame:
    """Recordings after the acute filters, causally, in order."""
    cuts = [(kind, order, (low, high) if kind == "bandstop" else low) for kind, low, high, order in ACUTE_FILTERS]
    return filtered(df, key, samples, [dsp.butterworth(order, cut, fs, kind) for kind, order, cut in cuts])


def filtered(df: DataFrame, key: Sequence[str], samples: str, sections: Sequence[np.ndarray], causal: bool = True) -> DataFrame:
    """Rows with their samples filtered by one filter after another."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            for sos in sections:
                x = dsp.filter_sections(sos, x)[0] if causal else dsp.filter_both_ways(sos, x)
            return x

        return column.map(one)

    return df.select(*key, run(samples).alias(samples))


def filtered_by_spec(df: DataFrame, spec: DataFrame, key: Sequence[str], channel: Sequence[str], samples: str, fs: float) -> DataFrame:
    """Band-stop filters of each channel's own rows in ``spec(*channel, low, high, order)``, then the samples."""
    stops = spec.groupBy(*channel).agg(F.sort_array(F.collect_list(F.struct("low", "high", "order"))).alias("_stops"))

    @F.pandas_udf("array<double>")
    def run(column: pd.Series, stops: pd.Series) -> pd.Series:
        def one(x, bands):
            for b in bands if bands is not None and x is not None else ():
                x = dsp.filter_both_ways(dsp.butterworth(int(b["order"]), (b["low"], b["high"]), fs, "bandstop"), x)
            return x

        return pd.Series([one(x, b) for x, b in zip(column, stops, strict=True)])

    rows = df.join(stops, list(channel), "left")
    return rows.select(*key, run(samples, "_stops").alias(samples))


def decimated(samples: str, power: int) -> Column:
    """Every 2^power-th sample."""
    return F.filter(samples, lambda _, i: i % (1 << power) == 0)


def without_artifacts(df: DataFrame, key: Sequence[str], samples: str, limit: float) -> DataFrame:
    """Samples over ``limit`` robust deviations (1.4826 x the median absolute one) from their recording's median lie on a line between their neighbours.

    Those at the ends take the next sample's value; missing ones stay missing. Recordings without any spread are left as they are.
    """

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            x = np.array(x, float)
            known = ~np.isnan(x)
            if not known.any():
                return x
            off = np.abs(x - np.median(x[known]))
            bad = known & (off > limit * 1.4826 * np.median(off[known]))
            good = known & ~bad
            if np.median(off[known]) > 0 and good.any():
                x[bad] = np.interp(np.flatnonzero(bad), np.flatnonzero(good), x[good])
            return x

        return column.map(one)

    return df.select(*key, run(samples).alias(samples))


def rereferenced(df: DataFrame, group: Sequence[str], i: str, value: str) -> DataFrame:
    """Long samples minus the mean of all channels at the same time."""
    means = df.groupBy(*group, i).agg(F.avg(value).alias("_m"))
    return df.join(means, [*group, i]).withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def preprocess(df: DataFrame, key: Sequence[str], samples: str, fs: float, decimate: int = 0, high_pass: float | None = None, low_pass: float | None = None, line: float | None = None, harmonics: int = 1, artifacts: float | None = None) -> DataFrame:
    """Without artifacts over a limit of deviations, decimation, high- and low-pass, and band-stops around the line frequency and its harmonics, in this order."""
    rate = fs / (1 << decimate)
    filters = []
    if high_pass:
        filters.append(dsp.butterworth(4, high_pass, rate, "highpass"))
    if low_pass:
        filters.append(dsp.butterworth(4, low_pass, rate, "lowpass"))
    for h in range(1, harmonics + 1) if line else ():
        if line * h + 2 < rate / 2:
            filters.append(dsp.butterworth(4, (line * h - 2, line * h + 2), rate, "bandstop"))
    rows = df if artifacts is None else without_artifacts(df, key, samples, artifacts)
    rows = rows.withColumn(samples, decimated(samples, decimate)) if decimate else rows
    return filtered(rows, key, samples, filters, causal=False)


def convolved(df: DataFrame, key: Sequence[str], samples: str, taps: Sequence[float]) -> DataFrame:
    """Recordings through a finite response, causally, from rest; a missing sample leaves those that it reaches missing."""
    h = F.array(*[F.lit(float(v)) for v in taps])

    def at(i: Column) -> Column:
        last = F.reverse(F.slice(samples, F.greatest(F.lit(1), i - len(taps) + 1), F.least(i, F.lit(len(taps)))))
        return F.aggregate(F.zip_with(last, F.slice(h, F.lit(1), F.size(last)), lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)

    made = F.when(F.size(samples) > 0, F.transform(F.sequence(F.lit(1), F.size(samples)), at)).otherwise(F.col(samples))
    return df.select(*key, made.alias(samples))


def fir_filtered(df: DataFrame, key: Sequence[str], samples: str, fs: float, low: float, high: float, notch: bool = False) -> DataFrame:
    """Zero-phase band-pass (0: open end) or notch."""
    h = dsp.fir(fs, low, high, notch=notch)

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None or not len(x) else dsp.fir_both_ways(h, np.asarray(x, float)))

    return df.select(*key, run(samples).alias(samples))


def frequency_grid(df: DataFrame, fs: float, nfft: int, low: float, high: float) -> DataFrame:
    """Each row with ``findex, f``: the grid's frequencies in the pass band."""
    step = fs / nfft
    rows = df.withColumn("findex", F.explode(F.sequence(F.lit(0), F.lit(nfft // 2))))
    f = F.col("findex") * step
    return rows.withColumn("f", f).where((F.col("f") >= low) & (F.col("f") <= high))
