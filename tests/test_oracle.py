"""Every query with SQL against DuckDB at the smallest scale; the others must run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from counterfair.plans.base import TABLES
from tools.check_oracle import rows_of

SF_DIR = "/root/testdata/sf0.001"
# The long searches repeat one round many times; the tools script checks them at full length.
SLOW = ("g1_global_search", "g1_clustered", "g4_", "g5_", "a13_search", "a12_report_of_search")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(SLOW)])
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
