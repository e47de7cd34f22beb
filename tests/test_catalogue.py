"""Every catalogue query against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from lodestone.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        p = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows_as_duckdb(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda row: [(x is None, str(x)) for x in row]
    mine = sorted(([norm(r[c]) for c in columns] for r in got.collect()), key=key)
    theirs = sorted(([norm(r[want.columns.index(c)]) for c in columns] for r in want.fetchall()), key=key)
    assert mine == theirs
