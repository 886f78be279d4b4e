"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from shelfcast.plans.oracle import ORACLE
from shelfcast.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "events lineitem part".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(value):
    return value.isoformat()[:10] if hasattr(value, "isoformat") else round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = sorted(([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=str)
    rel = duck.execute(ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in rel.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 8
    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
