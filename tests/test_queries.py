"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([str(r[i]) if not isinstance(r[i], float) else f"{r[i]:.6g}" for i in order] for r in values), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
