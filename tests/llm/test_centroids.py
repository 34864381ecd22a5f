import hashlib
import math
import random

import pytest
from oracle import assert_same, connection

from tidepool.llm import centroids, queries

SF = "/root/testdata/sf0.001"
TABLE = "vec_id long, embedding array<float>, label int, cluster string, q int"


def _expected(rows, k=16, rounds=3, width=64):
    """Lloyd's rounds over every row in plain Python."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [max(-(2**26), min(2**26, math.floor(64 * x))) for x in v]))
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(centers)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centers[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [nearest(v) for _, v in kept]
    inertia, of_cluster = sum(d for d, _ in found), {}
    for d, c in found:
        of_cluster[c] = of_cluster.get(c, 0) + d
    return sorted(str((i, c, d, of_cluster[c], inertia, centers[c])) for (i, _), (d, c) in zip(kept, found))


def _rows(df):
    return sorted(str((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid)) for r in df.collect())


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    expected = _expected([(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()])
    assert _rows(centroids.cluster(table)) == expected
    digests = {r.vec_id: r.centroid_sha256 for r in queries.op13_centroids(spark, SF).collect()}
    for r in centroids.cluster(table).collect():
        assert digests[r.vec_id] == hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest()


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    rng = random.Random(seed)
    few = [[rng.choice([-0.5, 0.1, 0.25]) for _ in range(4)] for _ in range(12)]
    rows = [(i, rng.choice(few)) for i in range(400)] + [(i, few[0]) for i in range(400, 700)]
    rows += [(700, None), (701, []), (702, [1.0] * 3), (703, [1.0] * 5), (704, [None, 1.0, 1.0, 1.0]), (705, [float("nan")] * 4), (706, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(707, [0.0] * 4), (None, few[1]), (None, few[2]), (5, few[3]), (5, few[3]), (708, [-1e30, 1e30, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], TABLE)
    assert _rows(centroids.cluster(table, k=6, width=4)) == _expected(rows, k=6, width=4)


def test_fewer_rows_than_centroids_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-3.0, 9.0])]
    made = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], TABLE)
    assert _rows(centroids.cluster(made, width=2)) == _expected(rows, width=2)
    assert centroids.cluster(made).collect() == []
    assert centroids.cluster(made.limit(0)).collect() == []


def test_components_at_the_limits(spark):
    """Huge components are held within the limits."""
    table = spark.range(64).selectExpr("id vec_id", "array(cast(if(id % 2 = 0, 1e30, -1e30) as float)) embedding").repartition(3)
    rows = centroids.cluster(table, k=1, width=1).collect()
    assert {r.distance for r in rows} == {2**52} and {r.inertia for r in rows} == {64 * 2**52} and rows[0].centroid == [0]


def test_query_equals_its_sql(spark):
    assert_same(queries.queries()["op13_centroids"](spark, SF), connection(SF), queries.oracle_sql()["op13_centroids"])
