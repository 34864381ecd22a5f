"""Best-fit packing of documents into sequences by the linear grouping scheme."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.store import written
from tidepool.llm.tokens import encode

CAPACITY = 1024
END_ID = 2
#: ``(groups, small)`` that are tried; the plan with the fewest sequences is taken.
CHOICES = ((48, 1 / 4), (96, 2 / 5), (24, 1 / 2))


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents: ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit ids).

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A document's ids are its text's
    (null: of the empty text) and then ``end_id``. Longer ones than ``capacity`` are cut into pieces of
    that many ids, the first being what is over. A repeated row gives its pieces again, a null ``doc_id``
    stays null, and an empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids")}
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(tokenizer, text.as_py(), end_id)
                first = len(ids) % capacity or capacity
                ends = [*range(first, len(ids) + 1, capacity)]
                for piece, end in enumerate(ends):
                    start = 0 if piece == 0 else end - capacity
                    for name, x in zip(out, (doc_id.as_py(), piece, start, end - start, ids[start:end].tobytes()), strict=True):
                        out[name].append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


# The plan: made on the driver from the number of pieces of each length, so never more than
# ``capacity`` numbers go in, however many pieces there are.


def _pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits ``capacity`` and is worth most, by dynamic programming."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = np.flatnonzero(sizes <= room)
        worth = best[room - sizes[fit]] + values[fit]
        if len(fit) and worth.max() > best[room - 1] + 1e-12:
            best[room], chosen[room] = worth.max(), fit[worth.argmax()]
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            pattern[chosen[room]] += 1
            room -= sizes[chosen[room]]
    return best[capacity], pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """``(pattern, times)``: whole parts of a fractional optimum for few sizes, by column generation.

    Every pattern says how many items of each size go into one sequence. Demand that the whole
    parts leave uncovered is left to the caller.
    """
    columns = [np.eye(len(sizes), dtype=int)[i] * (capacity // s) for i, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    amount = np.linalg.solve(basis, demand.astype(float))
    for _ in range(60 * len(sizes)):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, pattern = _pattern(prices, sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[out], basis[:, out] = pattern, pattern
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
    return [(c, int(a + 1e-6)) for c, a in zip(columns, amount, strict=True) if a + 1e-6 >= 1]


class Plan:
    """Where the r-th piece of each length goes: blocks ``(length, first rank, pieces, first sequence, offset)``."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.blocks: list[tuple[int, int, int, int, int]] = []
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[tuple[int, int]]] = {}  # free places: runs of sequences (first, number)

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.blocks.append((length, int(self.used[length]), count, first, offset))
        self.used[length] += count

    def best_fit(self, length: int, count: int) -> None:
        """``count`` pieces of one length, each into the fullest sequence that has room, run by run."""
        while count:
            free = min((f for f, runs in self.open.items() if f >= length and runs), default=None)
            if free is None:
                per = self.capacity // length
                n = max(1, count // per)
                self.open.setdefault(self.capacity, []).append((self.sequences, n))
                self.sequences += n
                continue
            first, n = self.open[free].pop()
            each = min(free // length, count)
            full = min(n, count // each)
            for i in range(each):
                self.put(length, full, first, self.capacity - free + i * length)
            count -= each * full
            if full < n:
                self.open[free].append((first + full, n - full))
            self.open.setdefault(free - each * length, []).append((first, full))


def plan(counts: np.ndarray, capacity: int, groups: int = 48, small: float = 1 / 8) -> Plan:
    """Packing of ``counts[l]`` pieces of each length ``l``.

    Pieces longer than ``small`` of the capacity are sorted and cut into ``groups`` groups of equal
    number; each length counts as the longest of its group. Configurations of these few sizes
    are optimised, their places are given to actual pieces, longest first, and what a piece is
    shorter than its group's size stays free. Best fit then puts the pieces that the whole
    configurations left over, and the small ones, longest first.
    """
    made = Plan(capacity)
    made.put(capacity, int(counts[capacity]), 0, 0)
    made.sequences = int(counts[capacity])
    left = counts.astype(np.int64).copy()
    left[capacity] = left[0] = 0
    lengths = np.flatnonzero(left)
    large = lengths[lengths > capacity * small]
    ranked = np.cumsum(left[large[::-1]])  # from the longest
    if len(large) > 1:
        size = max(1, -(-int(ranked[-1]) // groups))
        group = (ranked - 1) // size
        sizes = np.array([large[::-1][group == g].max() for g in np.unique(group)])
        members = [large[::-1][group == g] for g in np.unique(group)]
        demand = np.array([left[m].sum() for m in members])
        for pattern, times in configurations(sizes, demand, capacity):
            first = made.sequences
            slots = [g for g, k in enumerate(pattern) for _ in range(k)]
            rows = [_take(members[g], left, times) for g in slots]  # for each place, runs of actual lengths
            made.sequences += times
            cuts = sorted({0, times, *(int(c) for r in rows for c in np.cumsum([n for _, n in r])[:-1])})
            where = [0] * len(rows)
            done = [0] * len(rows)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                offset = 0
                for i, runs in enumerate(rows):
                    while where[i] < len(runs) and done[i] + runs[where[i]][1] <= lo:
                        done[i] += runs[where[i]][1]
                        where[i] += 1
                    if length := runs[where[i]][0] if where[i] < len(runs) else 0:
                        made.put(length, hi - lo, first + lo, offset)
                        offset += length
                made.open.setdefault(capacity - offset, []).append((first + lo, hi - lo))
    for length in np.flatnonzero(left)[::-1]:
        made.best_fit(int(length), int(left[length]))
    return made


def _take(members: np.ndarray, left: np.ndarray, times: int) -> list[tuple[int, int]]:
    """``times`` pieces of a group, longest first, as runs ``(length, number)``; length 0 where it has no more."""
    runs = []
    for length in members:
        if n := min(times, int(left[length])):
            runs.append((int(length), n))
            left[length] -= n
            times -= n
    return [*runs, (0, times)] if times else runs


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences without gaps of at most ``capacity``.

    ``pieces`` needs ``length`` (1 to ``capacity``) and is read more than once: give it as a written
    table. Its other columns are kept; ``_``-named ones are used inside. The count of each length goes
    to the driver, which plans runs of equal sequences. A piece finds its run by its rank among
    those of its length: a rank in its bucket (a hash of the row) plus the counts of earlier
    buckets, so that the most frequent length is never gathered. Equal rows are interchangeable.
    An empty table stays empty.
    """
    names = pieces.columns
    by_row = pieces.withColumn("_row", F.xxhash64(*names))
    n = max(64, pieces.sparkSession.sparkContext.defaultParallelism * 8)
    by_row = by_row.withColumn("_bucket", F.pmod("_row", F.lit(n)))
    counts = written(by_row.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    total = np.zeros(capacity + 1, dtype=np.int64)
    for length, k in counts.groupBy("length").agg(F.sum("_n")).collect():  # at most ``capacity`` rows
        total[length] = k
    made = min((plan(total, capacity, *choice) for choice in CHOICES), key=lambda p: p.sequences)
    blocks = np.array(sorted(made.blocks), dtype=np.int64).reshape(-1, 5)
    wide = 1 << 44
    starts = blocks[:, 0] * wide + blocks[:, 1]

    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_bucket").orderBy("_row", *names)
    ranked = by_row.withColumn("_rank", F.row_number().over(inside) - 1).join(base, ["length", "_bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": blocks[at, 3] + rank.to_numpy() - blocks[at, 1], "offset": blocks[at, 4]})

    placed = ranked.withColumn("_at", find("length", F.col("_rank") + F.col("_base")))
    return placed.select(*names, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Documents packed into sequences: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and ``ids``.

    Without ``keep_ids`` the ids themselves are left out once their checksum is taken. The pieces are
    written to the shared folder, so that every document is tokenised once.
    """
    pieces = tokenize_pieces(docs, tokenizer, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    return place(written(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the ids of each packed sequence, its pieces joined by place (at most a capacity)."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"))
