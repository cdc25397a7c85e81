"""Spark jobs vs the DuckDB oracle on the smallest driver tables: equal values, and something to compare."""
import duckdb
import pytest

from scripts.oracle_check import digest
from tidewater.registry import oracle_sql, queries
from tidewater.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
# jobs that the larger oracle run covers and that take long to start
SLOW = {"r8_group_frequencies", "r26_prefilter", "r27_audit_vocabulary", "m6_top_matches", "n14_classify_feed"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - SLOW))
def test_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    _, have = digest(df.columns, got)
    _, want = digest(cols, cur.fetchall())
    assert have == want
