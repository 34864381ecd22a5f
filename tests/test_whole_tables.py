"""Queries without SQL take all rows of their tables."""

from pyspark.sql import functions as F

from tidepool.queries import QUERIES, WIDTH, vectors

SF = "/root/testdata/sf0.001"


def test_models_take_all_vectors_and_components(spark):
    d = "/root/testdata/sf0.1"
    rows = vectors(spark, d)
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    assert rows.count() == n > 500 and rows.where(F.size("x") != WIDTH).isEmpty()
    sizes = rows.groupBy("subject").count()
    assert sizes.count() == n / 100 and sizes.agg(F.max("count")).first()[0] == 100


def test_models_take_all_subjects(spark):
    for name in ("m6_svm", "m7_ridge"):
        assert QUERIES[name](spark, SF).agg(F.countDistinct("vec_id")).first()[0] == 500, name
    ways = QUERIES["m11_transfer"](spark, SF).groupBy("way").agg(F.min("vec_id"), F.max("vec_id"), F.countDistinct("vec_id")).collect()
    assert {tuple(r) for r in ways} == {("there", 100, 499, 400), ("back", 0, 399, 400)}
    assert QUERIES["m18_acute_decoding"](spark, SF).where("r2 is not null").count() == 5
    assert QUERIES["m16_coefficients"](spark, SF).agg(F.countDistinct("name")).first()[0] == WIDTH


def test_limits_follow_the_length_of_series(spark):
    d = "/root/testdata/sf0.1"
    for name, key, fixed in (("e5_durbin_levinson", "event_type", 2000), ("e6_pacf", "user_id", 60)):
        n = {r[key]: r["count"] for r in spark.read.parquet(f"{d}/events.parquet").where("value is not null").groupBy(key).count().collect()}
        rows = QUERIES[name](spark, d).collect()
        expected = [abs(r.pacf) > 1.959963984540054 / max(n[r[key]] - 1 - r.lag, 1) ** 0.5 for r in rows]
        assert [r.significant for r in rows] == expected
        other = [abs(r.pacf) > 1.959963984540054 / max(fixed - 1 - r.lag, 1) ** 0.5 for r in rows]
        print(name, "differ", sum(a != b for a, b in zip(expected, other)), "of", len(rows), "significant", sum(other), sum(expected))
