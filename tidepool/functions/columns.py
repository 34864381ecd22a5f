"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as NULL in every float column, so that aggregates skip it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 as a bigint: differences of times are exact."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def hour_class(ts: str | Column) -> Column:
    """0 from 5 to 14 o'clock, 1 from 14 on, else null."""
    h = F.hour(ts)
    return F.when((h >= 5) & (h < 14), 0).when(h >= 14, 1)


def stars(p: str | Column, alpha: float = 0.05) -> Column:
    return F.when(F.col(p) < alpha if isinstance(p, str) else p < alpha, F.lit("***")).otherwise("")


def result_text(value: str, p: str) -> Column:
    """``0.71 (p=0.01***)``"""
    return F.concat(F.format_string("%.2f (p=%.2f", F.col(value), F.col(p)), stars(p), F.lit(")"))


def parse_result(text: str) -> list[Column]:
    """``value`` and ``p`` of a result text."""
    number = r"([-+0-9.eE]+)"
    return [
        F.regexp_extract(text, rf"^\s*{number}", 1).cast("double").alias("value"),
        F.regexp_extract(text, rf"\(p=\s*{number}", 1).cast("double").alias("p"),
    ]


def contact_pair(text: str) -> list[Column]:
    """The two contact numbers in ``E3E1``."""
    return [F.regexp_extract(text, r"E(\d+)E(\d+)", i).cast("int").alias(f"contact_{i}") for i in (1, 2)]


def smoothing_width(factor: str | Column) -> Column:
    """N of a factor named ``..._smoothN``, else null."""
    return F.nullif(F.regexp_extract(factor, r"_smooth(\d+)", 1), F.lit("")).cast("int")


def decibel(power: Column) -> Column:
    return F.lit(10.0) * F.log10(power + F.lit(2.220446049250313e-16))


def next_power_of_two(n: Column) -> Column:
    """0 of 0, whose logarithm Spark has as null."""
    return F.when(n == 0, 0.0).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def closed_band(f: Column, low: Column, high: Column, closed: str = "right") -> Column:
    """Whether a frequency is in a band: (low, high] or [low, high)."""
    return (f > low) & (f <= high) if closed == "right" else (f >= low) & (f < high)
