"""Repeated passages, found by bucket-pointer refinement over byte positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.store import text_key, written

#: A passage is removed from this many bytes on; it must be 16 times a quarter of ``GRAM``.
LENGTH = 400
#: Bytes of the buckets that are exchanged first, and window starts that a refining block holds.
GRAM = 100
BLOCK = 16

#: Bytes of documents that are worked on together in a task.
CHUNK = 1 << 21

_PLACE = (1 << 22) - 1


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b if isinstance(b, np.ndarray) else np.uint64(b))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _longer(ids: np.ndarray, by: int) -> np.ndarray:
    """Bucket identifiers of strings ``by`` bytes longer: each position's, refined by the one at the later offset."""
    return _mixed(ids[:-by], ids[by:]) if len(ids) > by else ids[:0]


def identifiers(data: np.ndarray) -> dict[int, np.ndarray]:
    """Identifiers of the 100-, 200- and 400-byte strings at each position, from bytes by way of 2, 4, 8, 16, 25 and 50.

    Every round sorts into finer buckets by the identifier at a later offset, and uses the identifiers of the round
    before; as they are fingerprints of the string and not ranks, they hold across documents without an exchange.
    """
    ids = _mixed(data.astype(np.uint64) + np.uint64(1), 0x2545F4914F6CDD1D)
    for by in (1, 2, 4, 8, 9, 25, 50):
        ids = _longer(ids, by)
    out = {100: ids}
    out[200] = _longer(ids, 100)
    out[400] = _longer(out[200], 200)
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of ``LENGTH`` bytes that lie in one document: ``place, first, last, gram, span``.

    A window's anchor is the last of its smallest ``GRAM``-byte identifiers (of their upper bits), so equal windows have it at the same
    place. Windows with one anchor follow each other, from ``first`` to ``last``; ``span`` tells all their bytes
    and where the anchor is in them.
    """
    ids = identifiers(data)
    width = LENGTH - GRAM + 1
    if not len(ids[LENGTH]):
        return (np.zeros(0, np.int64),) * 5
    place = np.arange(len(ids[GRAM]), dtype=np.uint64)
    low = np.uint64(_PLACE)
    least = _sliding_min((ids[GRAM] & ~low) | (low - (place & low)), width)
    at = (low - (least & low)).astype(np.int64)
    begin = np.zeros(len(least), bool)
    begin[0] = True
    begin[1:] = at[1:] != at[:-1]
    begin[ends[ends < len(begin)]] = True
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(begin)) - 1
    limit = ends[np.searchsorted(ends, first, side="right")] - LENGTH  # the last window of the document
    last = np.minimum(last, limit)
    ok = last >= first
    first, last = first[ok], last[ok]
    anchor = at[first]
    span = _mixed(_mixed(ids[LENGTH][first], ids[LENGTH][last]), ((anchor - first) * LENGTH + (last - first)).astype(np.uint64))
    return anchor, first, last, ids[GRAM][anchor].view(np.int64), span.view(np.int64)


def _chunks(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Bytes of some documents, their ends, and ``(row, offset in its text, length)`` of each; long texts come in parts.

    Parts overlap by one byte less than a window, so that each window is in exactly one part. What comes together has places of
    ``_PLACE`` at most.
    """
    parts: list[bytes] = []
    owners: list[tuple[int, int, int]] = []
    held = 0

    def made() -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        out = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), list(owners)
        parts.clear()
        owners.clear()
        return out

    for row, text in enumerate(texts):
        for lo in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            part = text[lo : lo + CHUNK + LENGTH - 1]
            if parts and held + len(part) > _PLACE:
                yield made()
                held = 0
            parts.append(part)
            owners.append((row, lo, len(part)))
            held += len(part)
            if held >= CHUNK:
                yield made()
                held = 0
    if parts:
        yield made()


def anchors(docs: DataFrame) -> DataFrame:
    """``key_a, key_b, place, first, last, gram, span``: a row for each anchor of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            texts = ((t.as_py() or "").encode() for t in batch.column(0))
            for data, ends, owners in _chunks(texts):
                place, first, last, gram, span = _anchors(data, ends)
                own = np.array(owners, np.int64).reshape(-1, 3)
                which = np.searchsorted(ends, first, side="right")
                shift = own[which, 1] - (ends[which] - own[which, 2])
                rows = own[which, 0]
                columns = [a[rows], b[rows], place + shift, first + shift, last + shift, gram, span]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["key_a", "key_b", "place", "first", "last", "gram", "span"])

    schema = "key_a long, key_b long, place long, first long, last long, gram long, span long"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(text.alias("text"), *_key(docs)).mapInArrow(run, schema)


def _key(docs: DataFrame) -> list:
    """Fingerprints of a row's id and text: equal rows have equal ones, and their strings count twice."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64("doc_id", text).alias("key_a"), F.xxhash64(F.lit(7919), text, "doc_id").alias("key_b")]


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes that the windows of ``wanted`` anchors cover: ``gram, key_a, key_b, place, first, bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "key_a", "key_b", "place", "first", "bytes"]
        for batch in batches:
            out: list[tuple] = []
            for text, a, b, found in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = text.as_py().encode()
                out += [(x["gram"], a.as_py(), b.as_py(), x["place"], x["first"], data[x["first"] : x["last"] + LENGTH]) for x in found.as_py()]
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)

    by_text = wanted.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("gram", "place", "first", "last")).alias("found"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), *_key(docs)).join(by_text, ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b"])
    schema = "gram long, key_a long, key_b long, place long, first long, bytes binary"
    return rows.select("text", "key_a", "key_b", "found").mapInArrow(run, schema)


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Of all contexts of a batch: context and its distance before the anchor, of each window; identifiers; the window's position."""
    sizes = np.array([len(x) for x in batch.column(5).to_pylist()], np.int64)
    data = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8)
    starts = np.cumsum(sizes) - sizes
    n = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(sizes)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place, first = (batch.column(i).to_numpy() for i in (3, 4))
    return owner, (place - first)[owner] - inside, identifiers(data), starts[owner] + inside, inside


def _blocks(contexts: DataFrame) -> DataFrame:
    """``gram, key_a, key_b, place, block, core, span, low, high``: windows of an anchor in blocks by their distance before it.

    ``core`` tells the bytes that all of a whole block's windows share, as far as the document goes on; ``span`` those of
    the block's own windows, from distance ``low`` to ``high``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                owner, distance, ids, at, _ = _windows(batch)
                block = distance // BLOCK
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(owner)) - 1
                # A whole block's windows all hold the bytes from distance block * BLOCK before the anchor on, for LENGTH - BLOCK + 1 bytes.
                core_at = at[first] + distance[first] - block[first] * BLOCK
                tail = core_at + LENGTH - BLOCK + 1 - 2 * GRAM
                core = _mixed(ids[200][core_at], ids[200][tail])
                span = _mixed(ids[LENGTH][at[first]], ids[LENGTH][at[last]])
                own = [batch.column(i).to_numpy()[owner[first]] for i in range(4)]
                columns = [*own, block[first], core.view(np.int64), span.view(np.int64), distance[last], distance[first]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    names = ["gram", "key_a", "key_b", "place", "block", "core", "span", "low", "high"]
    return contexts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _single(contexts: DataFrame, blocks: DataFrame) -> DataFrame:
    """``gram, key_a, key_b, place, distance, window`` of the windows in ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                owner, distance, ids, at, _ = _windows(batch)
                wanted = batch.column(6).to_pylist()
                pairs = np.array([i * 4096 + b for i, bs in enumerate(wanted) for b in bs], np.int64)
                keep = np.isin(owner * 4096 + distance // BLOCK, pairs)
                own = [batch.column(i).to_numpy()[owner[keep]] for i in range(4)]
                columns = [*own, distance[keep], ids[LENGTH][at[keep]].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    names = ["gram", "key_a", "key_b", "place", "distance", "window"]
    keys = ["gram", "key_a", "key_b", "place"]
    wanted = blocks.groupBy(keys).agg(F.collect_list("block").alias("blocks"))
    rows = contexts.join(wanted, keys).select("gram", "key_a", "key_b", "place", "first", "bytes", "blocks")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _with_count(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows with ``name``: whether their values in ``by`` come twice at least."""
    twice = rows.groupBy(by).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*by, F.lit(True).alias(name))
    return rows.join(twice, by, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``key_a, key_b, first, last``: bytes (last exclusive) covered by strings of ``LENGTH`` bytes that start elsewhere too.

    1. Each window has an anchor, whose ``GRAM``-byte bucket is exchanged (two for each 300 bytes). Anchors with equal gram and
       span hold equal windows, which are then all repeated.
    2. Where a bucket has several spans, one anchor of each goes on. Its windows are refined in blocks by identifiers at
       offsets relative to the anchor: a block whose span comes twice is repeated whole; one whose core comes once isn't at all.
    3. Windows of the other blocks are compared singly.
    Every comparison is a map-side combined count by content and a join with what comes twice, whose sides Spark can split.
    """
    rows = written(anchors(docs), "anchors")
    classes = rows.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key_a", "key_b", "place", "first", "last")).alias("x"))
    classes = written(classes, "spans")
    several = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("gram")
    contested = classes.join(several, "gram").select("gram", "x.*")
    contexts = written(_contexts(docs, contested), "contexts")
    whole = rows.join(classes.where("n > 1").select("gram", "span"), ["gram", "span"], "left_semi")
    whole = whole.select("key_a", "key_b", "first", (F.col("last") + LENGTH).alias("last"))

    blocks = written(_blocks(contexts), "blocks")
    blocks = _with_count(blocks, ["gram", "block", "core"], "possible").where("possible").drop("possible")
    blocks = written(_with_count(blocks, ["gram", "block", "core", "span", "low", "high"], "sure"), "shared-blocks")
    sure = blocks.where("sure").select("key_a", "key_b", (F.col("place") - F.col("high")).alias("first"), (F.col("place") - F.col("low") + LENGTH).alias("last"))
    unsure = blocks.groupBy("gram", "block", "core").agg(F.min("sure").alias("all_sure")).where("not all_sure").select("gram", "block", "core")
    single = written(_single(contexts, blocks.join(unsure, ["gram", "block", "core"])), "windows")
    single = _with_count(single, ["gram", "distance", "window"], "twice").where("twice")
    first = F.col("place") - F.col("distance")
    single = single.select("key_a", "key_b", first.alias("first"), (first + LENGTH).alias("last"))
    return whole.unionByName(sure).unionByName(single)


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``data``, and the number of maximal runs that went."""
    kept, at, runs, end = [], 0, 0, -1
    for first, last in sorted(spans):
        if first > end:
            runs += 1
            kept.append(data[at:first])
        end = max(end, last)
        at = max(at, last)
    return b"".join([*kept, data[at:]]), runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: every row's text as UTF-8 bytes without repeated passages.

    A byte goes if a string of ``LENGTH`` bytes covers it that starts at another place as well, in the same document or
    another one; strings are judged on the input. ``kept`` is binary, as a cut may fall inside a character. ``docs`` needs ``doc_id`` and
    ``text``; other columns are ignored. A null text is an empty one; repeated rows repeat all their
    passages; an empty table stays empty.
    """
    spans = repeated_spans(docs).distinct().groupBy("key_a", "key_b").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, runs = [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                kept, n = _cut(text.as_py().encode(), [(x["first"], x["last"]) for x in spans.as_py() or ()])
                left.append(kept)
                runs.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(left, pa.binary()), pa.array(runs, pa.int64())], ["doc_id", "text", "kept", "n_spans"])

    both = docs.select("doc_id", text.alias("text"), *_key(docs)).join(spans, ["key_a", "key_b"], "left")
    out = both.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, text string, kept binary, n_spans long")
    size = F.octet_length("text").cast("long")
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), "n_spans", "kept")
