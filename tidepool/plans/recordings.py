"""Recordings from raw samples to features, and the comparisons that are made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import dsp
from tidepool.functions.columns import contact_pair
from tidepool.operators import agg, inference, select, series, spectral, timejoin


def load_recordings(df: DataFrame, key: Sequence[str], samples: str, contact: str, start_us: str, fs: str, most: int, excluded: DataFrame | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Recordings with their bipolar contacts, at most ``most`` samples, and the time of the last one; without excluded ordinals of a group."""
    rows = select.without_ordinals(df, excluded, group, list(key)) if excluded is not None else df
    rows = rows.withColumn(samples, F.slice(samples, 1, most))
    end = F.col(start_us) + ((F.size(samples) - 1) / F.col(fs) * 1e6).cast("long")
    return rows.select("*", *contact_pair(contact), end.alias("end_us"))


def quiet_recordings(df: DataFrame, group: Sequence[str], samples: str, times: float = 10.0) -> DataFrame:
    """Recordings whose standard deviation is within ``times`` interquartile ranges of the group's quartiles."""
    n = F.size(samples)
    mean = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x) / n
    rows = df.withColumn("_m", mean).withColumn("sd", F.sqrt(F.aggregate(F.transform(samples, lambda x: (x - F.col("_m")) * (x - F.col("_m"))), F.lit(0.0), lambda s, x: s + x) / (n - 1)))
    return agg.within_iqr(rows, group, "sd", times).drop("_m")


def power_features(df: DataFrame, key: Sequence[str], channel: str, samples: str, fs: float, bands: Mapping[str, tuple[float, float]], channels: Sequence[str], line: float | None = None, high_pass: float | None = 1.0) -> DataFrame:
    """``window, ends, features``: decibels of each channel and band, in one array for each window of a second, and the window's end in seconds."""
    clean = spectral.preprocess(df, [*key, channel], samples, fs, high_pass=high_pass, line=line)
    power = spectral.band_powers(clean, [*key, channel], samples, fs, bands)
    names = [f"{c}_{b}" for c in channels for b in bands]
    wide = power.withColumn("_f", F.concat_ws("_", channel, "band")).groupBy(*key, "window").pivot("_f", names).agg(F.first("db"))
    n = round(fs)
    return wide.select(*key, "window", (((F.col("window") + 1) * n - 1) / fs).alias("ends"), F.array(*names).alias("features"))


def synced_temperature(features: DataFrame, temperature: DataFrame, t: str, keys: Sequence[str], value: str, samples_at: float, step: int) -> DataFrame:
    """Features with the first temperature in each step, low-passed at 0.5 Hz before."""
    arrays = temperature.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(t, value))).alias("s"))
    arrays = arrays.select(*keys, F.transform("s", lambda x: x[t]).alias("ts"), F.transform("s", lambda x: x[value]).alias("v"))
    smooth = spectral.filtered(arrays, [*keys, "ts"], "v", [dsp.butterworth(4, 0.5, samples_at, "lowpass")], causal=False)
    long = smooth.select(*keys, F.explode(F.arrays_zip("ts", "v")).alias("z")).select(*keys, F.col("z.ts").alias(t), F.col("z.v").alias(value))
    return timejoin.synced(features, long, t, step, keys, value)


def compared_bouts(df: DataFrame, subject: str, trial: str, order: Sequence[str], value: str, label: str, seconds: float) -> DataFrame:
    """``measure, n1, n0, z, p, adjusted`` of every subject: rates and durations of a trial's runs between the two classes of trials."""
    found = series.bouts(df, [subject, trial], order, value)
    classes = df.groupBy(subject, trial).agg(F.max(label).alias("_y"))
    rates = found.withColumn("rate", F.col("bouts") / seconds).join(classes, [subject, trial])
    measures = ("rate", "mean_duration", "percent")
    long = rates.withColumns({m: F.col(m).cast("double") for m in measures}).unpivot([subject, "_y"], list(measures), "measure", "v")
    z = inference.rank_sum(long, [subject, "measure"], "v", "_y").withColumn("p", inference.two_sided_p("z"))
    return inference.fdr_adjusted(z, ["measure"], "p").drop("corrected")
