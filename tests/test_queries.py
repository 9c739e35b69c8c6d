import math

import duckdb
import pytest

import __spark_entry__ as entry
import oracle

FOLDER = "/root/testdata/sf0.001"
TABLES = ("conversations", "documents", "embeddings", "orders")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def close(one, two):
    if isinstance(one, float) and isinstance(two, float):
        return math.isclose(one, two, abs_tol=1.5e-6)
    return one == two


@pytest.mark.parametrize("name", oracle.statements())
def test_query_equals_its_sql(spark, database, name):
    got = entry.queries()[name](spark, FOLDER)
    assert entry.oracle_sql()[name] == oracle.statements()[name]
    want = database.execute(oracle.statements()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    ours = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    theirs = sorted(want.fetchall(), key=repr)
    assert len(ours) == len(theirs)
    assert all(close(a, b) for x, y in zip(ours, theirs) for a, b in zip(x, y))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_own_query_has_its_sql():
    assert set(entry._own_queries()) == set(oracle.statements())
