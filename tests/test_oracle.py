"""Every registered query against its checking SQL in DuckDB, whole tables at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from vitaloom.plans.oracle import SQL as ORACLE
from vitaloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    expected = [dict(zip(columns, row)) for row in cursor.fetchall()]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got == sorted(repr([plain(r[c]) for c in order]) for r in expected)
    assert got


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_is_offered_with_its_sql():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
