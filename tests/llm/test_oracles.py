"""Operators that SQL can express, against DuckDB over whole tables."""

import os

import duckdb
import pytest

from lodestone.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        p = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got, want = queries.queries()[name](spark, DATA), c.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(x) for x in columns]
    key = lambda r: [(x is None, x) for x in r]
    assert sorted(([r[x] for x in columns] for r in got.collect()), key=key) == sorted(([r[k] for k in at] for r in want.fetchall()), key=key)
