"""Driver contract: entry smoke test and every registered query against its DuckDB oracle (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from keymerge.plans.catalog import QUERIES
from tests.oracle_check import TABLES, canon

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["c_custkey", "c_name", "total_spent", "n_orders", "avg_order", "first_order", "last_order"]


def test_every_query_has_oracle_or_is_listed():
    missing = set(QUERIES) - set(E.oracle_sql())
    assert missing == set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        pytest.skip("no SQL oracle")
    res = duck.execute(sql)
    assert canon(df.columns, srows) == canon([d[0] for d in res.description], res.fetchall())
