import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidepool.llm import packing, shards, tokens

RUNS = [
    " " * 1_000_000, "\n" * 1_000_000, "a" + " " * 1_000_000 + "b", " \n\t　" * 100_000 + "x", "x" + " " * 200_000 + "<|endoftext|>" + "\n" * 20_000 + " y",
    ("w " * 5 + " " * 12_000 + "\n v") * 5 + " " * 20_000, "\x1c" * 20_000 + "a", "z" * 300_000,
]


@pytest.mark.parametrize("run", range(len(RUNS)))
def test_long_runs_against_the_library(tokenizer, run):
    assert tokens.encode(tokenizer, RUNS[run], None).tolist() == Tokenizer.from_file(tokenizer).encode(RUNS[run], add_special_tokens=False).ids


def test_long_runs_in_packing_and_shards(docs, tokenizer):
    rows = [(i, t) for i, t in enumerate(RUNS)]
    library = Tokenizer.from_file(tokenizer)
    expected = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    made = packing.pack(docs(rows), tokenizer, keep_ids=False).collect()
    assert all(r.ids_crc32 == zlib.crc32(np.array(expected[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in made)
    assert sum(r.length for r in made) == sum(map(len, expected.values()))
    manifest, path = shards.training_order(docs(rows), tokenizer)
    order = sorted(manifest.collect(), key=lambda r: (r.part, r.ordinal))
    read = list(shards.read_slots(path, 0, len(order)))
    assert np.concatenate([read[r.slot][: r.n_tokens] for r in order]).tolist() == [x for i in expected.values() for x in i]


def test_clashing_names_and_long_texts(spark, tokenizer):
    rows = spark.createDataFrame([(1, "a b " * 100_000, 1, 2, "x"), (2, "c", 3, 4, "y")], "doc_id long, text string, length int, sequence_id int, _row string")
    assert sum(r.length for r in packing.pack(rows, tokenizer, keep_ids=False).collect()) > 200_000
    assert shards.training_order(rows, tokenizer)[0].count() > 190
