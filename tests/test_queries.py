"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "orders events embeddings lineitem".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda c: columns[c])
    out = [tuple(plain(r[c]) for c in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def test_every_query_has_sql():
    assert set(entry._series_queries()) == set(entry._series_sql())


@pytest.mark.parametrize("name", list(entry._series_queries()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
