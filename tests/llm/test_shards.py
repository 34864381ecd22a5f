import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm import shards


def test_feistel_is_a_permutation_that_depends_on_the_key(spark):
    for n in (1, 2, 3, 17, 64, 1000):
        ids = spark.range(n)
        one = [r[0] for r in ids.select(shards.feistel(F.col("id"), n, "a")).collect()]
        assert sorted(one) == list(range(n))
        if n > 16:
            other = [r[0] for r in ids.select(shards.feistel(F.col("id"), n, "b")).collect()]
            assert one != other and one != list(range(n))


def test_round_trip(spark, real, tokenizer):
    library = Tokenizer.from_file(tokenizer)
    manifest, path = shards.training_order(real, tokenizer, length=256, per_shard=64)
    rows = sorted(manifest.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all(r.shard == r.slot // 64 and r.byte_offset == r.slot % 64 * 512 for r in rows)
    read = list(shards.read_slots(path, 0, len(rows), 256, 64))
    assert [x.tolist() for x in shards.read_slots(path, 70, 20, 256, 64)] == [x.tolist() for x in read[70:90]]
    order = sorted(rows, key=lambda r: (r.part, r.ordinal))
    stream = np.concatenate([read[r.slot][: r.n_tokens] for r in order]).tolist()
    expected = [i for r in real.collect() for i in [*library.encode(r.text or "", add_special_tokens=False).ids, 2]]
    assert stream == expected


def test_edges(docs, tokenizer):
    manifest, path = shards.training_order(docs([(1, None), (None, ""), (3, "word " * 100), (3, "word " * 100)]), tokenizer, length=16, per_shard=4)
    rows = manifest.collect()
    assert sum(r.n_tokens for r in rows) == 2 + 2 * 102 and sorted(r.slot for r in rows) == list(range(len(rows)))
    assert shards.training_order(docs([]), tokenizer)[0].collect() == []
