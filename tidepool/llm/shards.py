"""Training order: a keyed permutation of all sequences, written as shards of fixed stride."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.store import bind, new_path, written
from tidepool.llm.tokens import encode, encoder

LENGTH = 1024
END_ID = 2
PER_SHARD = 1024
#: A walk is longer with a probability under (3/4) ** MOST_STEPS, 1e-25 here; it then fails rather than give a wrong slot.
MOST_STEPS = 200


def cut_sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Token streams cut into sequences: ``part, ordinal, first_doc_id, n_tokens, ids``.

    Each input partition's documents, each ended by ``end_id``, follow each other and are cut every
    ``length`` ids, so that only a partition's last sequence is shorter (``n_tokens``). ``ids`` holds
    unsigned 16-bit numbers, little-endian (the vocabulary must fit). ``first_doc_id`` is the
    document that its first id belongs to. Null texts are empty ones, that is just ``end_id``; a null
    ``doc_id`` stays null; repeated rows are repeated; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ordinal = TaskContext.get().partitionId(), 0
        held, size, owner = [], 0, None
        rows: list[tuple] = []

        def sequence(ids: np.ndarray) -> None:
            nonlocal ordinal
            rows.append((part, ordinal, owner, len(ids), ids.astype("<u2").tobytes()))
            ordinal += 1

        def table() -> pa.RecordBatch:
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            rows.clear()
            names = ["part", "ordinal", "first_doc_id", "n_tokens", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(tokenizer, text.as_py(), end_id)
                if not size:
                    owner = doc_id.as_py()
                held.append(ids)
                size += len(ids)
                if size >= length:
                    stream = np.concatenate(held)
                    whole = size // length * length
                    for at in range(0, whole, length):
                        sequence(stream[at : at + length])
                        owner = doc_id.as_py()
                    held, size = [stream[whole:]], size - whole
            if len(rows) >= 256:
                yield table()
        if size:
            sequence(np.concatenate(held))
        yield table()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "part int, ordinal long, first_doc_id long, n_tokens int, ids binary")


def round_keys(key: str, rounds: int) -> list[int]:
    """Keys of the rounds: the first 31 bits of SHA-256 over the key and the round's number."""
    return [int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:4], "big") >> 1 for i in range(rounds)]


def feistel(index: Column, count: int, key: str, rounds: int = 4) -> Column:
    """A keyed permutation of 0 .. ``count`` - 1 as one JVM expression.

    A balanced Feistel network over the smallest even number of bits that holds ``count`` values;
    a value that falls outside walks on through the network until it falls inside, which takes four steps
    on average at most and always ends, since the network is a permutation. So two indexes never share a slot.
    """
    half = max(1, -(-max(count - 1, 1).bit_length() // 2))
    mask = (1 << half) - 1
    keys = F.array(*[F.lit(k) for k in round_keys(key, rounds)])

    def once(x: Column) -> Column:
        start = F.struct(F.shiftright(x, half).alias("l"), x.bitwiseAND(F.lit(mask)).alias("r"))

        def step(s: Column, k: Column) -> Column:
            mixed = F.xxhash64(s["r"], k).bitwiseAND(F.lit(mask))
            return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(mixed).alias("r"))

        return F.aggregate(keys, start, step, lambda s: F.shiftleft(s["l"], half).bitwiseOR(s["r"]))

    def walk(x: Column) -> Column:
        steps = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), x, lambda v, _: F.when(v < count, v).otherwise(once(v)))
        return bind(steps, lambda v: F.when(v < count, v).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long")))

    return bind(once(index.cast("long")), lambda v: F.when(v < count, v).otherwise(walk(v)))


def training_order(
    docs: DataFrame, tokenizer: str, key: str = "order-1", length: int = LENGTH, end_id: int = END_ID, per_shard: int = PER_SHARD, path: str | None = None
) -> tuple[DataFrame, str]:
    """Writes all sequences in training order; returns their manifest and the shards' folder.

    Manifest: ``slot, shard, byte_offset, n_tokens, first_doc_id, part, ordinal, ids_crc32``. Slots are 0 .. number of
    sequences - 1, each taken once. Shard ``s`` is the binary file ``shard-<s>.bin`` with the sequences of
    slots ``s * per_shard`` and on, each in ``2 * length`` bytes (unsigned 16-bit ids, little-endian; a
    shorter sequence is filled up with ``end_id``); so a slot's place follows from its number, and reading can
    stop and go on anywhere. An empty table gives an empty manifest and no shard.

    A sequence's index is its ordinal in its partition plus the counts of earlier partitions: one row
    for each input partition goes to the driver, the sequences never do. The sequences are written first, so
    that indexes stay the same if an executor is lost. A task then joins its sequences for one shard and
    compresses them, before they go to range partitions of whole shards. A shard is put together in memory (``per_shard`` x 2 x
    ``length`` bytes), written under a name of its own and renamed, so a task that is run again replaces it by the same bytes.
    """
    if encoder(tokenizer).max_token_value > 0xFFFF or end_id > 0xFFFF:
        raise ValueError("ids must fit into 16 bits")
    spark = docs.sparkSession
    cut = written(cut_sequences(docs, tokenizer, length, end_id), "sequences", level=9)
    sizes = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([r.n for r in sizes], dtype=np.int64)])
    count = int(starts[-1])
    base = spark.createDataFrame([(r.part, int(s)) for r, s in zip(sizes, starts[:-1], strict=True)], "part int, base long")
    slot = feistel(F.col("base") + F.col("ordinal"), max(count, 1), key)
    placed = cut.join(F.broadcast(base), "part").withColumn("slot", slot)  # its rows are those that the driver has just counted
    files = cut.inputFiles()  # their names have the store's scheme, which tasks need
    path = path or (f"{files[0].rsplit('/', 2)[0]}/shards-{uuid.uuid4().hex}" if files else new_path(spark, "shards"))
    rows = ["slot", "part", "ordinal", "first_doc_id", "n_tokens"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(9).compress
        for batch in batches:
            slots = batch.column(0).to_numpy()
            order = np.argsort(slots)
            shards, first = np.unique(slots[order] // per_shard, return_index=True)
            ends = [*first[1:].tolist(), len(order)]
            lists = [pa.ListArray.from_arrays(pa.array([*first.tolist(), len(order)], pa.int32()), batch.column(i).take(pa.array(order))) for i in range(5)]
            ids = batch.column(5).take(pa.array(order)).to_pylist()
            packed = [pack(b"".join(ids[a:b])) for a, b in zip(first.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *lists, pa.array(packed, pa.binary())], ["shard", *rows, "packed"])

    schema = "shard long, slot array<long>, part array<int>, ordinal array<long>, first_doc_id array<long>, n_tokens array<int>, packed binary"
    grouped = placed.select(*rows, "ids").mapInArrow(gather, schema)
    shards = max(1, -(-count // per_shard))
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = grouped.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("shard")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        shard, held = None, []

        def put() -> pa.RecordBatch:
            block = np.full((min(per_shard, count - shard * per_shard), length), end_id, "<u2")
            columns: list[list] = [[] for _ in range(5)]
            for row in held:
                stream, at = np.frombuffer(unpack(row[5]), "<u2"), 0
                for one, n in zip(row[0], row[4], strict=True):
                    block[one - shard * per_shard, :n] = stream[at : at + n]
                    at += n
                for column, values in zip(columns, row, strict=False):
                    column += values
            own_name = f"{folder}/.part-{uuid.uuid4().hex}"
            with store.open_output_stream(own_name) as out:
                out.write(block.tobytes())
            store.move(own_name, f"{folder}/shard-{shard:08d}.bin")
            sums = [zlib.crc32(block[one - shard * per_shard].tobytes()) for one in columns[0]]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([shard] * len(sums), pa.int64()), pa.array(sums, pa.int64())], [*rows, "shard", "ids_crc32"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(7)), strict=True):
                values = [x.as_py() for x in row]
                if held and values[0] != shard:
                    yield put()
                    held.clear()
                shard = values[0]
                held.append(values[1:])
        if held:
            yield put()

    out = "slot long, part int, ordinal long, first_doc_id long, n_tokens int, shard long, ids_crc32 long"
    manifest = written(ordered.mapInArrow(lay, out), "manifest")
    offset = (F.col("slot") - F.col("shard") * per_shard) * (2 * length)
    names = ["slot", "shard", "byte_offset", "n_tokens", "first_doc_id", "part", "ordinal", "ids_crc32"]
    return manifest.withColumn("byte_offset", offset).select(names), path


def read_slots(path: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Ids of ``count`` slots from ``first`` on, read in order, one seek for each shard."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    while count > 0:
        shard, at = divmod(first, per_shard)
        with store.open_input_file(f"{folder}/shard-{shard:08d}.bin") as file:
            file.seek(at * 2 * length)
            n = min(count, per_shard - at)
            for _ in range(n):
                yield np.frombuffer(file.read(2 * length), "<u2")
        first, count = first + n, count - n
