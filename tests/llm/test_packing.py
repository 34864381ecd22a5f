import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidepool.llm import packing


def _check(rows, expected, capacity, whole=True):
    """Pieces are the documents', sequences hold no more than they can, without gaps."""
    got, places = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    for doc_id, ids in expected:
        pieces = sorted(got[doc_id])
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert [p[1] for p in pieces] == [sum(p[2] for p in pieces[:i]) for i in range(len(pieces))]
        assert sum(p[2] for p in pieces) == len(ids) and all(p[2] == capacity for p in pieces[1:])
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for _, s, n, c in pieces)
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end if whole else offset >= end
            end = offset + length
        assert end <= capacity
    return len(places)


def test_whole_table_against_the_library(spark, real, tokenizer):
    library = Tokenizer.from_file(tokenizer)
    texts = [(r.doc_id, r.text or "") for r in real.collect()]
    expected = [(d, [*library.encode(t, add_special_tokens=False).ids, 2]) for d, t in texts]
    rows = packing.pack(real, tokenizer, keep_ids=False).collect()
    n = _check(rows, expected, 1024)
    assert n <= -(-sum(len(i) for _, i in expected) // 1024) * 1.05 + 1


def test_edges(docs, tokenizer):
    rows = [(1, None), (2, ""), (3, "word " * 3000), (4, "a<|endoftext|>b"), (5, "same"), (6, "same"), (6, "same"), (None, "x")]
    packed = packing.pack(docs(rows), tokenizer)
    out = packed.collect()
    library = Tokenizer.from_file(tokenizer)
    _check([r for r in out if r.doc_id in range(1, 6)], [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows[:5]], 1024, whole=False)
    assert sum(r.length for r in out) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    assert [r.length for r in out if r.doc_id in (1, 2)] == [1, 1]
    assert bytes(next(r.ids for r in out if r.doc_id == 4)) == np.array([*library.encode("a<|endoftext|>b").ids, 2], "<u4").tobytes()
    assert len([r for r in out if r.doc_id == 6]) == 2 and len([r for r in out if r.doc_id is None]) == 1
    spots = [(r.sequence_id, r.offset) for r in out]
    assert len(spots) == len(set(spots))
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert sum(whole.values()) == sum(r.length for r in out) and max(whole.values()) <= 1024


def test_empty(docs, tokenizer):
    assert packing.pack(docs([]), tokenizer).collect() == []


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20), st.sampled_from(packing.CHOICES))
@settings(max_examples=60, deadline=None)
def test_plans_place_every_piece_once(counts, choice):
    total = np.zeros(65, dtype=np.int64)
    for length, n in counts.items():
        total[length] = n
    made = packing.plan(total, 64, *choice)
    assert (made.used == total).all()
    room = defaultdict(list)
    for length, rank, n, first, offset in made.blocks:
        for k in range(n):
            room[first + k].append((offset, length))
    assert len(room) <= made.sequences
    for parts in room.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64


@pytest.mark.parametrize("seed", range(3))
def test_plans_come_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    total = np.bincount(np.clip(rng.gamma(2, 120, 200_000).astype(int), 1, 1024), minlength=1025)
    best = min(packing.plan(total, 1024, *c).sequences for c in packing.CHOICES)
    assert best <= -(-(total * np.arange(1025)).sum() // 1024) * 1.001 + 1
