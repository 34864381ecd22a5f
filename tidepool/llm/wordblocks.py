"""Blocks of texts coded by their distinct words, and what belongs to a word joined back by position.

A block holds neighbouring texts of a partition as the numbers of their words in the block's own list of distinct
words. Only these lists are dealt out by word: all rows of a word meet in one partition, next to each other, where it is encoded once. So a word
is shuffled once for each block and not once for each time it occurs, however frequent it is, and no list of words goes through the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encode = Callable[[list[str]], pa.Array]

#: Characters of text in a block, and in a part of it that is split at once; a longer text is a block of its own.
BLOCK_CHARS = 1 << 24
PART_CHARS = 1 << 20
#: Words of a block's list in one Arrow batch.
LISTED = 10_000
#: Rows that a task gathers before it packs them by block.
PACKED = 500_000
#: Words of a block that are decoded, or joined to its texts, at once.
DECODED = 100_000
CONTENT = pa.schema([("no", pa.int32()), ("ids", pa.list_(pa.int32()))])


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, compressed."""
    return zstandard.ZstdCompressor(3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(planes: bytes) -> np.ndarray:
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(planes), np.uint8)
    return np.ascontiguousarray(plain.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None], int]]:
    """``(doc_ids, texts, characters)`` of neighbouring rows, some ``PART_CHARS`` at a time."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        ends = np.cumsum([len(t or "") for t in texts])
        lo, before = 0, 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, before + PART_CHARS, side="right")))
            yield batch.column(0).slice(lo, hi - lo), texts[lo:hi], int(ends[hi - 1]) - before
            lo, before = hi, int(ends[hi - 1])


def _blocks(split: Callable[[str | None], list[str]], block_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """``block, doc_ids, sizes, codes, words`` of one block after another."""
    ids: list[pa.Array] = []
    sizes: list[int] = []
    words: list[pa.Array] = []
    held = made = 0

    def block() -> tuple[int, pa.Array, np.ndarray, np.ndarray, pa.Array]:
        one = pa.chunked_array(words, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
        codes, listed = np.concatenate([c.indices.to_numpy() for c in one.chunks]), one.chunk(0).dictionary
        order = np.argsort(-np.bincount(codes, minlength=len(listed)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        listed = listed.take(pa.array(order))
        check = crc32(listed.buffers()[2] or b"") & 0xFFFFFF
        key = (TaskContext.get().partitionId() << 40) | (made << 24) | check
        return key, pa.concat_arrays(ids), np.array(sizes, np.int32), rank[codes], listed

    for doc_ids, texts, chars in _parts(batches):
        if held and held + chars > block_chars:
            yield block()
            ids, sizes, words, held, made = [], [], [], 0, made + 1
        lists = [split(t) for t in texts]
        ids.append(doc_ids)
        sizes += map(len, lists)
        words.append(pa.array([w for x in lists for w in x], pa.string()).dictionary_encode())
        held += max(chars, 1)
    if held:
        yield block()


class Coder:
    """Blocks of ``docs`` (``doc_id, text``): as ``texts``, and as the ``words`` of their lists; ``split`` gives a text's words.

    A block's words are numbered by frequency from 0. A text's row is known by its place in the block alone, so null and repeated ids are like any
    others. Both tables are made from ``docs`` by themselves, as texts in numbers are much of the input's size, and keeping them beside their shuffle would
    double that. So ``docs`` has to give the same rows in the same order, as a table in files does; a block's key holds a checksum of its list, and a
    block whose list is another one the second time is an error.
    """

    def __init__(self, docs: DataFrame, split: Callable[[str | None], list[str]], block_chars: int = BLOCK_CHARS) -> None:
        self.docs = docs.select("doc_id", F.col("text").cast("string"))
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        self.blocks = functools.partial(_blocks, split, block_chars)

    def texts(self) -> DataFrame:
        """``block, doc_ids, sizes, codes``: a row for each block."""
        blocks = self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, ids, sizes, codes, _ in blocks(batches):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), x) for x in (ids, pa.array(sizes))]
                yield pa.RecordBatch.from_arrays([pa.array([key]), *lists, pa.array([_planes(codes)], pa.binary())], ["block", "doc_ids", "sizes", "codes"])

        return self.docs.mapInArrow(run, f"block long, doc_ids array<{self.kind}>, sizes array<int>, codes binary")

    def words(self) -> DataFrame:
        """``block, no, word``: every block's distinct words."""
        blocks = self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, _, _, _, words in blocks(batches):
                order = pc.sort_indices(words)  # words that begin alike follow each other, which the shuffle's compression saves a tenth by
                for lo in range(0, len(words), LISTED):
                    no = order.slice(lo, LISTED).cast(pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(no), key)), no, words.take(no)], ["block", "no", "word"])

        return self.docs.mapInArrow(run, "block long, no int, word string")


def _encoded(encode: Encode, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, no, ids`` of ``block, no, word`` in order of words; each word is encoded once."""
    last, made = None, pa.nulls(0)
    for batch in batches:
        if batch.num_rows:
            coded = batch.column(2).dictionary_encode()
            own = coded.dictionary.to_pylist()
            known = [made.slice(len(made) - 1)] if own[0] == last else []
            made = pa.concat_arrays([*known, encode(own[len(known) :])])
            last = own[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made.take(coded.indices)], ["block", "no", "ids"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``of, content``: rows of one block as compressed Arrow batches, some ``PACKED`` rows at a time."""
    compress = zstandard.ZstdCompressor(3).compress

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("block").combine_chunks()
        block = table.column("block").to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        table = table.drop_columns("block").cast(CONTENT)
        content = [compress(pa.concat_batches(table.slice(a, b - a).to_batches()).serialize()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(content, pa.binary())], ["of", "content"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACKED:
            yield flush(held)
            held = []
    if held:
        yield flush(held)


def encoded(coder: Coder, encode: Encode) -> DataFrame:
    """``of, content``: numbers and ids of every block's words, packed by block; ``encode`` gives the ids of a list of distinct words and sees each word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(_encoded(encode, batches))

    return coder.words().repartition("word").sortWithinPartitions("word").mapInArrow(run, "of long, content binary")


def joined_back(coder: Coder, packed: DataFrame, decode: Callable[[pa.Array], pa.Array], separator: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every text: its words' ids one after another and their decoded texts with ``separator`` between them.

    ``packed``: see ``encoded``; ``decode`` gives the texts of words' ids. A task joins one block: what belongs to its words is taken at their positions in its texts.
    """

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError("the documents were read in another order the second time")
        unpack = zstandard.ZstdDecompressor().decompress
        parts = [pa.ipc.read_record_batch(pa.py_buffer(unpack(x.as_py())), CONTENT) for x in right.column("content")]
        rows = pa.Table.from_batches(parts, CONTENT).sort_by("no").combine_chunks()
        row = left.combine_chunks()
        codes, doc_ids = _numbers(row.column("codes")[0].as_py()), row.column("doc_ids").combine_chunks().flatten()
        if not np.array_equal(rows.column("no").to_numpy(), np.arange(codes.max() + 1 if len(codes) else 0)):
            raise RuntimeError("some of a block's words were not encoded")
        ids = pa.concat_arrays(rows.column("ids").chunks or [pa.array([], pa.list_(pa.int32()))])
        texts = pa.concat_arrays([pa.array([], pa.string()), *(decode(ids.slice(lo, DECODED)) for lo in range(0, len(ids), DECODED))])
        ends = np.append(0, np.cumsum(row.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.int64))
        made = []
        lo = 0
        while lo < len(doc_ids):  # some texts at a time, so that no large batch goes back
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + DECODED, side="right")) - 1)
            at, own = pa.array(codes[ends[lo] : ends[hi]]), ends[lo : hi + 1] - ends[lo]
            taken = ids.take(at)
            tokens = np.append(0, np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False), dtype=np.int64))[own]
            lists = pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), taken.flatten())
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(own, pa.int32()), texts.take(at)), separator)
            made.append(pa.table([doc_ids.slice(lo, hi - lo), lists, text], ["doc_id", "ids", "decoded"]))
            lo = hi
        return pa.concat_tables(made)

    return coder.texts().groupBy("block").cogroup(packed.groupBy("of")).applyInArrow(join, f"doc_id {coder.kind}, ids array<int>, decoded string")
