"""Importance resampling of documents towards a target distribution, by hashed word runs."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.store import written

BUCKETS = 10_000
SEED = 42
MIN_WORDS = 20
PERCENT = 5
#: Rows whose keys the borders of ranges are taken from, about, and rows in a range. Neither changes the result.
SAMPLE = 100_000
RANGE = 1 << 18
#: Entries of a sorted run in one row.
BLOCK = 1 << 14
NOTHING = np.iinfo(np.int64).min

#: Digits and letters stay, in lower case, and bytes of other characters too; all else is a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def features(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words of a whole text, and the buckets of its runs of one to three words.

    The checksum of a longer run goes on from that of the run without its last word, so no run is put together.
    """
    words = (text or "").encode().translate(_WORD_BYTES).split()
    marked = [b" " + w for w in words]
    ones = list(map(crc32, words))
    twos = list(map(crc32, islice(marked, 1, None), ones))
    threes = list(map(crc32, islice(marked, 2, None), twos))
    return len(words), np.array(ones + twos + threes, np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows of ``texts`` (``text``) in each bucket; each task counts its own, and the driver gets one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(features(text.as_py(), buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, a thousand times the logarithm of how much likelier it is in the target, rounded down; both counts are smoothed by one."""
    n, s, t = len(own), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``: weights by looking features up in ``gain``; the score adds a Gumbel variate of the id's hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, len(b), int(gain[b].sum())) for n, b in (features(t.as_py(), buckets) for t in batch.column(1))]
            numbers = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(numbers[:, i]) for i in range(3)]], ["doc_id", "n_words", "n_features", "weight"])

    made = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return made.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


class _Run:
    """A sorted run of (score descending, id, row), read block by block."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.keys = (k for scores, ids, rows in blocks for k in zip((-scores).tolist(), ids.tolist(), rows.tolist(), strict=True))
        self.head = next(self.keys, None)

    def step(self) -> None:
        self.head = next(self.keys, None)


def tournament(runs: list[_Run]) -> Iterator[tuple[int, int, int]]:
    """Keys of sorted runs in order, by a tree of losers: each step plays one match for each level on the way from the winner's leaf."""
    k = len(runs)
    if not k:
        return

    def beats(a: int, b: int) -> bool:
        return runs[a].head is not None and (runs[b].head is None or runs[a].head < runs[b].head)

    winners, loser = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while runs[best].head is not None:
        yield runs[best].head
        runs[best].step()
        node = (best + k) // 2
        while node:
            if beats(loser[node], best):
                best, loser[node] = loser[node], best
            node //= 2


def sorted_runs(keys: DataFrame, borders: list[tuple[int, int, int]]) -> DataFrame:
    """``range, run, block, scores, ids, rows``: every partition of ``keys`` (``score, id, row``) as a sorted run, cut where ranges end, in blocks, written.

    Ranges lie between ``borders`` (of ``(-score, id, row)``); range 0 comes first. Spark sorts a partition and spills what exceeds memory.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                scores, ids, rows = (part.column(i).to_numpy() for i in range(3))
                own = list(zip((-scores).tolist(), ids.tolist(), rows.tolist(), strict=True))
                start = 0
                while start < len(own):
                    place = bisect.bisect_right(borders, own[start])
                    end = bisect.bisect_left(own, borders[place], start) if place < len(borders) else len(own)
                    lists = [pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), pa.array(x[start:end])) for x in (scores, ids, rows)]
                    yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([run]), pa.array([block]), *lists], ["range", "run", "block", "scores", "ids", "rows"])
                    start, block = end, block + 1

    ordered = keys.select("score", "id", "row").sortWithinPartitions(F.desc("score"), "id", "row")
    return written(ordered.mapInArrow(cut, "range int, run long, block long, scores array<long>, ids array<long>, rows array<long>"), "runs")


def ranked(keys: DataFrame, count: int, draw: int, sample: int = SAMPLE, range_rows: int = RANGE) -> DataFrame:
    """``row, rank`` of the first ``draw`` of ``count`` rows of ``keys`` (``score, id, row``) by score (highest first), id and row.

    Partitions are written as sorted runs, cut at common borders that a bounded sample of keys gives. A task merges one range's pieces of all runs by a
    tournament tree; where a range's ranks start is the number of rows in those before it. Ranges that start after the draw aren't read,
    and the last one stops at its exact count.
    """
    share = min(1.0, sample / max(count, 1))
    picked = keys.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))).select("score", "id", "row").collect()
    ordered = sorted((-r.score, r.id, r.row) for r in picked)
    step = max(20, int(range_rows * share))
    runs = sorted_runs(keys, ordered[step::step])
    sizes = {r["range"]: r.n for r in runs.groupBy("range").agg(F.sum(F.size("ids")).alias("n")).collect()}  # one row a range: at most sample / 20
    starts, before = {}, 0
    for place in sorted(sizes):
        starts[place], before = before, before + sizes[place]
    last = max((p for p, s in starts.items() if s < draw), default=-1)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("block", "ascending")])
        place, by_run = table.column("range")[0].as_py(), {}
        for i, run in enumerate(table.column("run").to_pylist()):
            by_run.setdefault(run, []).append(tuple(table.column(c)[i].values.to_numpy() for c in ("scores", "ids", "rows")))
        rows = [k[2] for k in islice(tournament([_Run(b) for b in by_run.values()]), draw - starts[place])]
        return pa.table([pa.array(rows, pa.int64()), pa.array(starts[place] + 1 + np.arange(len(rows)))], ["row", "rank"])

    return runs.where(F.col("range") <= last).groupBy("range").applyInArrow(merge, "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs`` (``doc_id, text``), drawn towards the texts of ``target`` (``text``); other columns are ignored.

    Features are runs of one to three words of whole texts, hashed into ``buckets``; a bucket's gain compares its share of ``target`` and ``docs``, and a row's weight
    sums the gains of its features. Of the N rows with ``min_words`` words at least, ``percent * N // 100`` are drawn: those with the highest
    scores, ties to the smaller id. ``rank`` counts them from 1 in that order and is null for all others. A null text is an empty one (weight 0); a
    null id comes before all others in ties, and its hash is of nothing after the colon; repeated rows are rows of their own; an empty table stays empty.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    kind = docs.schema["doc_id"].dataType
    if kind.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be a whole number")
    table = written(scored(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    count = table.where(F.col("n_words") >= min_words).count()
    draw = percent * count // 100
    keys = table.where(F.col("n_words") >= min_words).select("score", F.coalesce(F.col("doc_id").cast("long"), F.lit(NOTHING)).alias("id"), "row")
    ranks = ranked(keys, count, draw)
    return table.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
