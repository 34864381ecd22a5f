import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from oracle import assert_same, connection

from tidepool.llm import queries, resampling

SF = "/root/testdata/sf0.001"


def _features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def _expected(docs, target, min_words=20, percent=5):
    """Rows in plain Python: (doc_id, n_features, weight, score, rank)."""
    own, theirs, made = [0] * 10000, [0] * 10000, [_features(t) for _, t in docs]
    for _, f in made:
        for b in f:
            own[b] += 1
    for t in target:
        for b in _features(t)[1]:
            theirs[b] += 1
    s, t = sum(own), sum(theirs)
    gain = [math.floor(1000 * math.log((y + 1) * (s + 10000) / ((x + 1) * (t + 10000)))) for x, y in zip(own, theirs)]
    rows = []
    for (doc_id, _), (n, f) in zip(docs, made):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], -math.inf if r[0] is None else r[0]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = i + 1
    return sorted(map(str, ((r[0], *r[2:]) for r in rows)))


def _rows(df):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


def test_whole_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op11_resample(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert _rows(got) == _expected(docs, target)


def test_odd_rows(spark, docs):
    rng = random.Random(3)
    words = ["ab", "Cd", "é1", "x-y", "日本", "Ω", "_", "42"]
    texts = [None, "", " ", "one", "two words", "w " * 100_000] + [" ".join(rng.choices(words, k=rng.randint(15, 60))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(7, texts[7])] * 3 + [(None, texts[8]), (None, texts[9])]
    target = [None, "", "ab Cd é1 x", "42 42 Ω"]
    got = resampling.resample(docs(rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "row long, text string"))
    assert _rows(got) == _expected(rows, target)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs([]), none).collect() == []
    rows = [(i, "some words here " * 10) for i in range(40)]
    assert _rows(resampling.resample(docs(rows), none)) == _expected(rows, [])


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 16, 33])
def test_tournament_merges_sorted_runs(runs):
    rng = np.random.default_rng(runs)
    made = []
    for r in range(runs):
        keys = sorted((-int(s), int(i), r * 1000 + k) for k, (s, i) in enumerate(zip(rng.integers(0, 5, r * 3), rng.integers(0, 4, r * 3))))
        made.append([(np.array([-k[0] for k in part], np.int64), np.array([k[1] for k in part], np.int64), np.array([k[2] for k in part], np.int64)) for part in (keys[:4], keys[4:])])
    plain = [[(-s, i, k) for block in run for s, i, k in zip(*(x.tolist() for x in block))] for run in made]
    assert list(resampling.tournament([resampling._Run(b) for b in made])) == list(heapq.merge(*plain))


@pytest.mark.parametrize(("draw", "ties"), [(0, 50), (1, 50), (997, 3), (5000, 1), (6000, 4000)])
def test_ranges_and_ties(spark, draw, ties):
    """Many runs and ranges, scores that most rows share, and a draw that ends anywhere."""
    keys = spark.range(6000, numPartitions=13).selectExpr(f"cast(hash(id) % {ties} as bigint) score", "id % 100 id", "id row")
    got = resampling.ranked(keys, 6000, draw, sample=2000, range_rows=200)
    expected = sorted(keys.collect(), key=lambda r: (-r.score, r.id, r.row))[:draw]
    assert [(r.row, r["rank"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == [(r.row, i + 1) for i, r in enumerate(expected)]


def test_query_equals_its_sql(spark):
    assert_same(queries.queries()["op11_resample"](spark, SF), connection(SF), queries.oracle_sql()["op11_resample"])
