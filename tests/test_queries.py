"""Every query with SQL equals it; ``test_values.py`` has the others' values."""

import pytest

from oracle import assert_same, connection
from tidepool.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.limit(1).count() == 1


def test_time_joins_make_no_loops(spark):
    for name in ("c1_within", "c2_far", "c3_nearest", "c4_synced", "c5_forward", "c6_trials"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["b13_marks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,signup)" in plan and "props" not in plan.rpartition("ReadSchema")[2]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
