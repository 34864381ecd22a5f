"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(rows) -> list[str]:
    return sorted(str(tuple(_plain(v) for v in r)) for r in rows)


def assert_same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    theirs = con.sql(sql)
    assert sorted(theirs.columns) == names
    quoted = ", ".join(f'"{n}"' for n in names)
    expected = con.sql(f"select {quoted} from ({sql})").fetchall()
    assert rows_of(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()) == rows_of(expected)
