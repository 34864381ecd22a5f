import random
from collections import Counter

from tidepool.llm import repeats


def _expected(texts):
    rows = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 400] for t in rows for i in range(len(t) - 399))
    out = []
    for t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        out.append((len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, y in zip(t, gone, strict=True) if not y)))
    return out


def _check(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs(list(enumerate(texts)))).collect()}
    expected = _expected(texts)
    assert [got[i] for i in range(len(texts))] == expected
    return expected


def test_planted_passages(docs):
    rng = random.Random(3)

    def noise(n):
        return "".join(rng.choice("abcdefg éß\n") for _ in range(n))

    passage, other = noise(900), noise(390)
    texts = [None, "", "short", noise(399), passage[:399], passage[:400]]
    texts += [noise(rng.randrange(300)) + passage[rng.randrange(200) : 500 + rng.randrange(400)] + noise(rng.randrange(300)) for _ in range(40)]
    texts += [noise(200) + other + noise(200) for _ in range(5)]  # shorter than a removal
    texts += [passage + noise(50) + passage, noise(100) + "x" * 1500 + noise(100), "y" * 401, "z" * 400, ("ab" * 700), noise(2000) * 2]
    texts += [noise(1200)] * 3
    expected = _check(docs, texts)
    assert sum(e[1] for e in expected) > 20_000


def test_edits_in_copies(docs):
    """Near copies: many spans and blocks in the same buckets, boundaries everywhere."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
    texts = []
    for _ in range(60):
        t = list(base[rng.randrange(500) : 2500 + rng.randrange(500)])
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    _check(docs, texts)


def test_long_texts_come_in_parts(docs, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    import numpy as np

    rng = random.Random(5)
    text = "".join(rng.choice("abcdef") for _ in range(5000)).encode()
    parts = list(repeats._chunks(iter([text, b"", text[:399], text[:400]])))
    windows = [data[s : s + 400].tobytes() for data, ends, owners in parts for e, (_, _, n) in zip(ends, owners, strict=True) for s in range(e - n, e - 399)]
    assert windows == [text[i : i + 400] for i in range(4601)] + [text[:400]]
    assert isinstance(parts[0][0], np.ndarray)


def test_empty_and_repeated_rows(docs):
    assert repeats.remove_repeats(docs([])).collect() == []
    rng = random.Random(6)
    text = "".join(rng.choice("abcdef") for _ in range(700))
    rows = repeats.remove_repeats(docs([(1, text), (1, text), (None, "a")])).collect()
    assert sorted((r.n_removed, r.n_spans) for r in rows) == [(0, 0), (700, 1), (700, 1)]


def test_chunks_keep_to_their_places():
    rng = random.Random(7)
    texts = [rng.randbytes(repeats.CHUNK - 1), rng.randbytes(repeats.CHUNK + 1000), b"a" * 500]
    parts = list(repeats._chunks(iter(texts)))
    assert max(len(data) for data, _, _ in parts) <= repeats._PLACE
    assert sum(n - 399 for _, _, owners in parts for _, _, n in owners) == sum(len(t) - 399 for t in texts)


def test_clashing_names(docs):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdef") for _ in range(500)) for _ in range(2)] * 2
    names = ("key_a", "key_b", "spans", "first", "last", "gram", "span", "place", "n_bytes", "kept", "found", "k")
    table = docs(list(enumerate(texts))).withColumns({c: F.lit(c) for c in names})
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(table).collect()) == [(i, 500, 500) for i in range(4)]
