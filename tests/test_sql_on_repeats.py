"""Queries equal their SQL on tables that are larger, with values that come often."""

import duckdb

from oracle import TABLES, assert_same, connection
from tidepool.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def with_events(tmp_path, sql: str) -> str:
    for name in TABLES:
        if name != "events":
            (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    duckdb.sql(f"copy ({sql}) to '{tmp_path}/events.parquet' (format parquet)")
    return str(tmp_path)


def test_automatic_bins_of_discrete_groups(spark, tmp_path):
    d = with_events(tmp_path, f"select e.* replace (event_id + k * 1000 as event_id) from '{SF}/events.parquet' e, range(4) t(k) where k = 0 or event_type in ('click', 'view')")
    assert QUERIES["v2_auto_bins"](spark, d).groupBy("event_type").count().where("event_type in ('click', 'view') and count > 100").count() == 2
    assert_same(QUERIES["v2_auto_bins"](spark, d), connection(d), SQL["v2_auto_bins"])


def test_values_that_equal_the_mean_are_no_bout(spark, tmp_path):
    """0.1 three times: their sum as doubles over 3 is above 0.1, of seven times below it; users' values come in many orders."""
    d = with_events(tmp_path, f"select e.* replace (user_id + 100 * n as user_id, event_id + 1000 * n as event_id, case when n = 0 then value else 0.1 * (1 + user_id) end as value) from '{SF}/events.parquet' e, range(3) t(n)")
    found = QUERIES["e7_bouts"](spark, d)
    assert found.where("user_id >= 100 and bouts > 0").isEmpty() and found.where("user_id >= 100").count() == 30
    assert_same(found, connection(d), SQL["e7_bouts"])


def test_what_rounds_to_zero_has_no_sign(spark, tmp_path):
    d = with_events(tmp_path, f"select * replace (value / 1e6 as value) from '{SF}/events.parquet'")
    for name, key in (("h13_least_squares", "user_id"), ("h14_designs", "user_id, kind")):
        expected = connection(d).sql(f"select samples from ({SQL[name]}) order by {key}").fetchall()
        found = QUERIES[name](spark, d).orderBy(*key.split(", ")).select("samples").collect()
        assert "0.0, " in str(expected), name
        assert [str(list(r[0])) for r in found] == [str(r[0]) for r in expected], name
