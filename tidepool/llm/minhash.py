"""Near-duplicates by min-max hashing of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.components import connected_components
from tidepool.llm.quality import SPACES, words
from tidepool.llm.store import bind, written

#: Each permutation gives two values, its minimum and its maximum. With 24 bands of 5 of the 120 values, a pair
#: at similarity 0.8 shares a band with probability 0.99993, one at 0.4 with 0.22.
PERMUTATIONS = 60
ROWS = 5
PERCENT = 80
#: Classes of a bucket that are compared with so many others in one task.
BLOCK = 256

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _shingles(flat: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document and where each document's start; ``flat``: its words' hashes, one after another.

    A document with fewer words than a shingle has its whole sequence as one; one without words has none.
    """
    n = np.diff(starts)
    made = np.maximum(n - size + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), made)
    first = np.repeat(starts[:-1], made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    last = np.minimum(first + size, starts[1:][owner])
    value = np.zeros(len(first), np.uint64)
    for k in range(size):
        inside = first + k < last
        value[inside] = _mixed(value[inside] * np.uint64(0x9E3779B97F4A7C15) + flat[(first + k)[inside]])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(n)))]).astype(np.int64)


def _bands(shingles: np.ndarray, starts: np.ndarray, permutations: int, rows: int) -> np.ndarray:
    """A row of band hashes for each document that has shingles."""
    rng = np.random.default_rng(20240517)
    factors = rng.integers(1, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    at = starts[:-1][np.diff(starts) > 0]
    values = np.empty((2 * permutations, len(at)), np.uint64)
    for i, (a, b) in enumerate(zip(factors, offsets, strict=True)):
        permuted = shingles * a + b
        values[2 * i], values[2 * i + 1] = np.minimum.reduceat(permuted, at), np.maximum.reduceat(permuted, at)
    bands = np.empty((len(at), 2 * permutations // rows), np.uint64)
    for j in range(bands.shape[1]):
        x = np.full(len(at), j, np.uint64)
        for value in values[j * rows : (j + 1) * rows]:
            x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + value)
        bands[:, j] = x
    return bands


def _lower(text: Column) -> Column:
    """A text (null: empty) with A-Z lower-cased and every separator a space."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + SPACES, UPPER.lower() + " " * len(SPACES))


def _hashed_words(docs: DataFrame) -> DataFrame:
    """``doc_id, content, key_a, key_b, words``: word hashes of lower-cased (A-Z) texts, and fingerprints of texts and of word sequences."""
    made = bind(words(_lower(F.col("text"))), lambda w: F.struct(F.xxhash64(w).alias("key_a"), F.xxhash64(F.lit(7919), w).alias("key_b"), F.transform(w, lambda x: F.xxhash64(x)).alias("words")))
    return docs.select(F.col("doc_id").cast("long"), _content(F.col("text")).alias("content"), made.alias("m")).select("doc_id", "content", "m.*")


def _content(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    starts = words.offsets.to_numpy().astype(np.int64)
    return words.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]].view(np.uint64), starts - starts[0]


def signatures(docs: DataFrame, size: int, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """``doc_id, content, key_a, key_b, n_shingles, bands``: one row for each row of ``docs``; bands: null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 400):
                batch = whole.slice(lo, 400)
                shingles, starts = _shingles(*_flat(batch.column(4)), size)
                n = np.diff(starts)
                bands = iter(_bands(shingles, starts, permutations, rows).view(np.int64) if len(shingles) else ())
                lists = pa.array([next(bands) if x else None for x in n], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64()), lists], ["doc_id", "content", "key_a", "key_b", "n_shingles", "bands"])

    schema = "doc_id long, content long, key_a long, key_b long, n_shingles long, bands array<long>"
    return _hashed_words(docs).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``id, shingles``: the full sets of texts with an ``id``, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 400):
                batch = whole.slice(lo, 400)
                shingles, starts = _shingles(*_flat(batch.column(1)), size)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "shingles"])

    rows = docs.select("id", words(_lower(F.col("text"))).alias("w"))
    return rows.select("id", F.transform("w", lambda x: F.xxhash64(x))).mapInArrow(run, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of pairs, by their full sets. Each ``a`` sends its set once, with all of its ``b``."""
    left = pairs.groupBy("a").agg(F.collect_set("b").alias("bs")).join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.select("a", "sa", F.explode("bs").alias("b")).join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    joined = F.size("sa") + F.size("sb") - F.col("i")
    return both.withColumn("i", shared).select("a", "b", (F.col("i") * 100 >= joined * percent).alias("linked"))


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with theirs and, in ``b``, that of the bucket's first class."""
    state = members.drop("b").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = state.groupBy("bucket").agg((F.min("component") < F.max("component")).alias("several"), F.min(F.struct("id", "n", "component")).alias("b"))
    return written(state.join(several.where("several").drop("several"), "bucket"), "open")


def _compare(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of a block of rows with ``is_query`` to a block of others, of another component, whose first shared band is this."""
    rows = rows.sort_values("id")
    asked, others = rows[rows["is_query"]], rows[~rows["is_query"]]
    if not len(asked) or not len(others):
        return pd.DataFrame({"a": [], "b": []})
    sizes = others["n"].to_numpy()
    starts = np.cumsum(sizes) - sizes
    known, place = np.unique(np.concatenate(others["shingles"].to_numpy()), return_inverse=True)
    bands, ids, components = np.stack(others["bands"].to_numpy()), others["id"].to_numpy(), others["component"].to_numpy()
    found: list[tuple[int, int]] = []
    for q in asked.itertuples(index=False):
        same = bands == q.bands
        first = same.any(1) & (bands[np.arange(len(bands)), same.argmax(1)] == q.bucket)
        near = first & (components != q.component) & (np.minimum(sizes, q.n) * 100 >= np.maximum(sizes, q.n) * percent)
        if near.any():
            at = np.searchsorted(known, q.shingles)
            inside = np.append(known, 0)[at] == q.shingles
            inside &= at < len(known)
            has = np.zeros(len(known), np.int64)
            has[at[inside]] = 1
            shared = np.add.reduceat(has[place], starts)
            linked = near & (shared * 100 >= (sizes + q.n - shared) * percent)
            found += [(max(q.id, i), min(q.id, i)) for i in ids[linked].tolist()]
    return pd.DataFrame(found, columns=["a", "b"])


def _rest(still: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between components of open buckets.

    Classes outside a bucket's largest component are compared with all of the bucket, block by block: a task has one block of
    either, however large the bucket is. A pair is compared in the first band that it shares, and no table of pairs is made.
    """
    counts = still.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"))
    parts = main.select("bucket", "main", F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("query_blocks"))
    rows = still.join(parts, "bucket").join(classes.select("id", "bands"), "id").join(sets, "id")
    names = ["bucket", "id", "component", "n", "bands", "shingles"]

    def dealt(rows: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_blocks)))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_blocks) - 1)))

    asked = dealt(rows.where("component <> main"), "q", "query_blocks", "m", "blocks").select(*names, "q", "m", F.lit(True).alias("is_query"))
    others = dealt(rows, "m", "blocks", "q", "query_blocks").select(*names, "q", "m", F.lit(False).alias("is_query"))
    return asked.unionByName(others).groupBy("bucket", "q", "m").applyInPandas(lambda x: _compare(x, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id, text``; other columns are ignored).

    Two documents are linked if 100 x the intersection of their sets of ``size``-word shingles is ``percent`` x their union at least;
    ``component_id`` is the smallest ``doc_id`` reached, ``kept`` marks it. A document without words is linked with
    nothing, nor is one without id (its ``component_id`` is null, it is kept). Repeated rows get the same values.

    Documents of equal word sequences are one class, which has a number of its own, so rows of one ``doc_id`` with different
    texts are told apart. Classes that share a band are a bucket. First, each class is paired with the
    first of all of its buckets, then with the first of each bucket where their components still
    differ. Sets confirm the pairs, links join components, and most buckets then hold one component. In the
    others, what is outside the largest component is compared with the whole bucket in blocks, so no link between components is lost.
    """
    return _judged(docs, size, percent, permutations, rows).drop("content")


def _judged(docs: DataFrame, size: int, percent: int, permutations: int, rows: int) -> DataFrame:
    """``near_duplicates`` with ``content``."""
    marks = written(signatures(docs, size, permutations, rows), "signatures")
    usable = marks.where("n_shingles > 0 and doc_id is not null")
    of_rows = usable.groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "content")).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(of_rows.withColumn("id", F.monotonically_increasing_id()), "classes")
    banded = classes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "n")).alias("b")).where("k > 1").drop("k")
    members = written(banded.join(shared, "bucket"), "buckets")
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "row.*")
    texts = docs.select(F.col("doc_id").cast("long"), _content(F.col("text")).alias("content"), "text").join(wanted, ["doc_id", "content"]).dropDuplicates(["id"])
    sets = written(shingle_sets(texts.select("id", "text"), size), "sets")
    near = F.least("n", "b.n") * 100 >= F.greatest("n", "b.n") * percent
    with_first = members.where(near & (F.col("id") != F.col("b.id"))).select(F.col("id").alias("a"), F.col("b.id").alias("b"))

    first = written(_confirmed(with_first.groupBy("a").agg(F.min("b").alias("b")), sets, percent), "judged")
    links = first.where("linked").select("a", "b")
    joined = connected_components(links, "a", "b")
    still = _open(members, joined)
    if not still.isEmpty():
        apart = still.where(near & (F.col("component") != F.col("b.component")))
        pairs = apart.select(F.col("id").alias("a"), F.col("b.id").alias("b")).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
        second = written(_confirmed(pairs, sets, percent), "judged")
        links = links.unionByName(second.where("linked").select("a", "b"))
        joined = connected_components(links, "a", "b")
        still = _open(members, joined)
    if not still.isEmpty():
        links = links.unionByName(written(_rest(still, classes, sets, percent), "links"))
        joined = connected_components(links, "a", "b")
    of_class = classes.select("key_a", "key_b", "row.doc_id", F.col("id").alias("node")).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.join(least, "component").select("key_a", "key_b", "component_id")
    out = marks.join(of_class, ["key_a", "key_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "content", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` with one document of each group of near-duplicates, the one with the smallest id; all columns stay.

    A row's verdict follows its id and text: repeated rows that stay all stay, and so do rows of the group's smallest id with other texts, and rows
    without words or without id.
    """
    verdict = _judged(docs, size, percent, PERMUTATIONS, ROWS).where("not kept").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_id"), _content(F.col("text")).alias("_content"))
    return rows.join(verdict, ["_id", "_content"], "left_anti").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
