import random

import numpy as np
import pandas as pd
import pytest

from tidepool.llm import minhash
from tidepool.llm.components import connected_components


def _components(sets, percent=80):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def _set(t, size):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(spark, real, size):
    texts = {r.doc_id: r.text for r in real.collect()}
    sets = {d: _set(t, size) for d, t in texts.items()}
    expected = _components(sets)
    for r in minhash.near_duplicates(real, size).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], r.doc_id == expected[r.doc_id])


def test_a_large_group_with_outliers(docs):
    """Edits of one text: many links, chains and outliers in the same buckets."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 7, 10, 14])):
            words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    expected = _components({d: _set(t, 2) for d, t in rows})
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), 2).collect()}
    assert got == expected and len(set(got.values())) > 1


def test_rows_of_one_id_with_other_texts(docs):
    """Each row is a document of its own, and its group's smallest id is its class."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(5)]
    rows = []
    for _ in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 5])):
            words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((rng.randrange(40), " ".join(words)))
    classes = _components({i: _set(t, 2) for i, (_, t) in enumerate(rows)})
    least = {}
    for i, (d, _) in enumerate(rows):
        least[classes[i]] = min(d, least.get(classes[i], d))
    expected = sorted((d, least[classes[i]]) for i, (d, _) in enumerate(rows))
    got = [(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs(rows), 2).collect()]
    assert sorted(got) == expected

    stay = minhash.drop_near_duplicates(docs(rows), 2).collect()
    assert sorted((r.doc_id, r.text) for r in stay) == sorted((d, t) for i, (d, t) in enumerate(rows) if d == least[classes[i]])
    linked = [(1, "w x y z"), (1, "z a b c d e f g h i j"), (2, "z a b c d e f g h i j q"), (3, "w x y z")]
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs(linked), 2).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_columns_of_inner_names_stay(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 5, 6, "x"), (2, "a b c d e f", 7, 8, "y")], "doc_id long, text string, content int, component_id int, _doc string")
    assert [tuple(r) for r in minhash.drop_near_duplicates(rows).collect()] == [(1, "a b c d e f", 5, 6, "x")]


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  b"), (7, "A  b"), (None, "a b"), (8, "ÀB x"), (9, "àb x"), (10, "word " * 20000)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(rows), 2).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (7, 1, 6, False), (None, 1, None, True), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 10, True)],
        key=str,
    )
    assert minhash.near_duplicates(docs([]), 2).collect() == []


def test_one_of_each_group_stays(docs):
    text = " ".join(f"w{i}" for i in range(100))
    out = minhash.drop_near_duplicates(docs([(3, text), (1, text), (2, text + " more"), (9, "other " + text[::-1])])).collect()
    assert sorted(r.doc_id for r in out) == [1, 9]


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    found = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 110, dtype=np.uint64)
        a, b = x[:100], x[11:]  # 89 of 110 shared
        bands = minhash._bands(np.concatenate([a, b[:99]]), np.array([0, 100, 199]), minhash.PERMUTATIONS, minhash.ROWS)
        found += bool((bands[0] == bands[1]).any())
    assert found >= 298


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 1), (6001, 6000), (6000, 6001)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 6000: 6000, 6001: 6000}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
    assert isinstance(minhash._compare(pd.DataFrame({"id": [], "is_query": pd.Series([], dtype=bool)}), 80), pd.DataFrame)
