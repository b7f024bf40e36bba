"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from quelora.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(registry.oracle_sql()) == set(registry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    found = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    left = sorted(str([r[c] for c in order]) for r in df.collect())
    at = [found.columns.index(c) for c in order]
    assert left == sorted(str([r[k] for k in at]) for r in found.fetchall())
