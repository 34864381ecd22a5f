import numpy as np

from tidepool.llm import rpforest

SCHEMA = "vec_id long, embedding array<float>, label int"


def _links(rows):
    found = {}
    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        v = np.array([np.float32(r[1]) for r in own], float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        hit = v @ v.T >= 0.93
        for r, h in zip(own, hit, strict=True):
            found[r[0]] = {own[j][0] for j in np.flatnonzero(h)} - {r[0]}
    return found


def test_cliques_chains_and_singles(spark):
    rng = np.random.default_rng(8)
    rows = []
    for label in (0, 1):
        centers = rng.normal(size=(6, 24))
        for c in centers:
            for _ in range(rng.choice([1, 3, 40, 300])):
                rows.append((len(rows), (c + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.2])).tolist(), label))
        rows += [(len(rows) + i, rng.normal(size=24).tolist(), label) for i in range(700)]
    expected = _links(rows)
    got = {r.vec_id: r for r in rpforest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    total = sum(len(x) for x in expected.values())
    assert all(got[i].n_links <= len(x) for i, x in expected.items()) and total > 10_000
    assert sum(r.n_links for r in got.values()) >= 0.99 * total
    seen = {}
    for i in sorted(expected):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in seen:
                seen[j] = i
                todo += expected[j]
    same = sum(got[i].component_id == c for i, c in seen.items())
    assert same >= 0.99 * len(seen) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_pairs_near_the_threshold_are_found(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(0, 3000, 2):
        a = rng.normal(size=32)
        b = rng.normal(size=32)
        b -= a * (a @ b) / (a @ a)
        b *= np.linalg.norm(a) / np.linalg.norm(b)
        c = 0.935
        rows += [(i, a.tolist(), 0), (i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
    expected = sum(len(x) for x in _links(rows).values())
    got = sum(r.n_links for r in rpforest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert 0.9 * expected <= got <= expected


def test_large_group_keeps_its_links(spark):
    """Members are near the threshold, not in balls, and many more than a leaf holds."""
    rng = np.random.default_rng(10)
    center = rng.normal(size=64)
    rows = [(i, (center + rng.normal(size=64) * rng.uniform(0.15, 0.27)).tolist(), 0) for i in range(3000)]
    rows += [(3000 + i, rng.normal(size=64).tolist(), 0) for i in range(1000)]
    expected = _links(rows)
    got = {r.vec_id: r.n_links for r in rpforest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    total = sum(len(x) for x in expected.values())
    print("links found", sum(got.values()), "of", total)
    assert total > 4_000_000 and all(got[i] <= len(x) for i, x in expected.items())
    assert sum(got.values()) >= 0.99 * total


def test_rows_of_one_id_with_other_vectors(spark):
    """Each row is a vector of its own."""
    rng = np.random.default_rng(11)
    c, o = rng.normal(size=(2, 8))
    rows = [(1, c.tolist(), 0), (1, o.tolist(), 0), (2, (c * 2 + 0.01).tolist(), 0), (3, (o + 0.01).tolist(), 0), (0, (o + 0.02).tolist(), 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rpforest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 2, 0, True), (1, 1, 1, True), (1, 2, 0, False), (2, 1, 1, False), (3, 2, 0, False)]


def test_edges(spark):
    v = [1.0] * 8
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0] * 8, 0), (7, [float("nan")] * 8, 0), (8, [float("inf")] + v[1:], 0), (9, [None] + v[1:], 0), (None, v, 0), (10, [], 0),
        (11, [2.0] * 8, 0), (12, [1.0] * 4, 0), (13, [-1.0] * 8, 0),
    ]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in rpforest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    assert sorted(x for x in got if x[0] in (1, 2, 11)) == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (11, 3, 1, False)]
    assert all(n == 0 and c == i and k for i, n, c, k in got if i not in (1, 2, 11))
    assert rpforest.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    from tidepool.llm import rpforest

    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 1), (4, None, 1)]
    names = ("id", "vec", "ok", "dim", "tree", "node", "home", "ball", "rows", "component", "n_links", "kept", "_label", "_vec")
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in names})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rpforest.near_duplicates(table).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_parallel_vectors(spark):
    """Multiples of one direction: equal as units, but not as vectors."""
    rng = np.random.default_rng(12)
    v, w = rng.normal(size=(2, 16))
    rows = [(i, (v * 2.0 ** (i % 100 - 50)).tolist(), 0) for i in range(400)] + [(400 + i, (w * (i + 1)).tolist(), 0) for i in range(300)]
    rows += [(700 + i, rng.normal(size=16).tolist(), 0) for i in range(300)]
    got = {r.vec_id: r for r in rpforest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    for first, n in ((0, 400), (400, 300)):
        assert all(got[i].component_id == first and got[i].n_links == n - 1 for i in range(first, first + n))


def planted_pairs(rng, pairs, singles, size=13, width=64, cosine=0.94):
    """Pairs of balls whose centers are far apart, with one link between an edge of each; and vectors by themselves."""

    def turned(a, angle):
        b = rng.normal(size=width)
        b -= a * (a @ b)
        return np.cos(angle) * a + np.sin(angle) * b / np.linalg.norm(b)

    rows, links, most = [], [], np.arccos(0.93) * 0.499
    for _ in range(pairs):
        u = rng.normal(size=width)
        u /= np.linalg.norm(u)
        v = turned(u, np.arccos(cosine))
        side = (v - u * (u @ v)) / np.linalg.norm(v - u * (u @ v))
        reach, gap = most * 0.96, np.arccos(cosine)
        at = lambda angle: np.cos(angle) * u + np.sin(angle) * side
        first = len(rows)
        for edge, center in ((u, at(-reach)), (v, at(gap + reach))):
            own = [center, edge, *(turned(center, rng.uniform(0, most * 0.3)) for _ in range(size - 2))]
            rows += [(len(rows) + i, x.tolist(), 0) for i, x in enumerate(own)]
        links.append((first, first + size))
    rows += [(len(rows) + i, rng.normal(size=width).tolist(), 0) for i in range(singles)]
    return rows, links


def test_links_between_balls(spark):
    rows, links = planted_pairs(np.random.default_rng(13), 100, 6000)
    got = {r.vec_id: r for r in rpforest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[a].component_id == got[b].component_id for a, b in links) >= 99
    expected = _links(rows)
    total = sum(len(x) for x in expected.values())
    assert all(got[i].n_links <= len(x) for i, x in expected.items()) and sum(r.n_links for r in got.values()) >= 0.99 * total
