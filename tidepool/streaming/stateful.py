"""Filters and recursions that go on from chunk to chunk, with their state kept by channel."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepool.functions import dsp, ssm

#: Held numbers of a recursion and rows of a channel, and what gives the rows' results and the numbers after them.
Advance = Callable[[np.ndarray | None, np.ndarray], tuple[np.ndarray, np.ndarray]]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """A recursion over each channel's rows in order of time, whatever order they come in within the watermark's delay.

    Rows wait in a list until the watermark has passed them, which a timer tells; then they are sorted and the recursion goes on from its held numbers. So
    a channel's state is those numbers, and its rows of the delay. Rows at or before the channel's last watermark are dropped: their turn is over.
    """

    def __init__(self, channel: str, t: str, value: str, advance: Advance) -> None:
        self.channel, self.t, self.value, self.advance = channel, t, value, advance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, v array<double>")
        self.held = handle.getValueState("held", "numbers array<double>, passed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = self.held.get()[1] if self.held.exists() else None
        new = []
        for part in rows:
            new += [(int(a), np.atleast_1d(np.asarray(v, float)).tolist()) for a, v in zip(part[self.t], part[self.value], strict=True) if passed is None or a > passed]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(a for a, _ in new) // 1000))  # timers are in milliseconds, rows in microseconds
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: r[0])
        due, rest = [r for r in rows if r[0] <= limit], [r for r in rows if r[0] > limit]
        if not due:
            yield pd.DataFrame()
            return
        before = np.array(self.held.get()[0]) if self.held.exists() else None
        made, numbers = self.advance(before, np.array([r[1] for r in due]))
        self.held.update((numbers.ravel().tolist(), limit))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.waiting.clear()
        yield pd.DataFrame({self.channel: [key[0]] * len(due), self.t: [r[0] for r in due], "_out": list(made)})

    def close(self) -> None:
        pass


def _ordered(df: DataFrame, channel: str, t: str, value: str, late: str, advance: Advance, out: str) -> DataFrame:
    """``channel, t`` and what ``advance`` makes (``out``: its name and type). Rows of no channel only move the watermark, so the filter on them names its column and stays above it."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # timers and lists need it
    kinds = dict(df.dtypes)
    rows = df.select(channel, t, value, F.timestamp_micros(t).alias("_at")).withWatermark("_at", late)
    rows = rows.where(F.when(F.col("_at").isNotNull(), F.col(channel).isNotNull()))
    name, kind = out.split()
    made = rows.groupBy(channel).transformWithStateInPandas(Ordered(channel, t, value, advance), f"{channel} {kinds[channel]}, {t} {kinds[t]}, _out {kind}", "Append", "EventTime")
    return made.withColumnRenamed("_out", name)


def filter_stream(df: DataFrame, channel: str, t: str, value: str, sos: np.ndarray, late: str = "10 seconds") -> DataFrame:
    """``channel, t, value``: a causal filter over each channel of a stream; ``t``: microseconds. Rows may come late by up to ``late`` (see ``Ordered``)."""

    def advance(held: np.ndarray | None, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return dsp.filter_sections(sos, values[:, 0], held)

    return _ordered(df, channel, t, value, late, advance, f"{value} double")


def kalman_stream(df: DataFrame, channel: str, t: str, x: str, a: np.ndarray, c: np.ndarray, k: np.ndarray, late: str = "10 seconds") -> DataFrame:
    """``channel, t, state``: predicted states of each channel of a stream, as in one batch; rows may come late by up to ``late``."""

    def advance(held: np.ndarray | None, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        states, _, last = ssm.kalman(values, a, c, k, held)
        return states, last

    return _ordered(df, channel, t, x, late, advance, "state array<double>")


def closing(spark: SparkSession, path: str, schema: str, after: Column) -> DataFrame:
    """A stream of one row of ``schema``, null but for ``ts`` at ``after``: joined to another stream, it moves the watermark beyond that one's last row. ``path``: a new folder."""
    row = spark.range(1).select(*[(after.cast("timestamp") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in spark.createDataFrame([], schema).schema])
    row.write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def window_power(df: DataFrame, channel: Sequence[str], ts: str, value: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Mean square of each channel's values in windows of event time; windows close ``late`` after their end."""
    rows = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = rows.groupBy(*channel, F.window(ts, width).alias("w")).agg(F.count(value).alias("n"), F.avg(F.col(value) * F.col(value)).alias("power"))
    return rows.select(*channel, F.col("w.start").alias("start"), "n", "power")
