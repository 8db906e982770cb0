import re
from pathlib import Path

import pytest

from counterfair.plans.base import QUERIES
from counterfair.plans import registry  # noqa: F401 - registers the queries

TABLES = {
    "region": "SELECT CAST(id AS INT) AS r_regionkey, CAST(id AS STRING) AS r_name FROM range(5)",
    "nation": "SELECT CAST(id AS INT) AS n_nationkey, CAST(id % 5 AS INT) AS n_regionkey FROM range(25)",
    "customer": "SELECT id AS c_custkey, CAST(id % 25 AS INT) AS c_nationkey, CAST(id * 37 % 1000 AS DOUBLE) AS c_acctbal,"
    " element_at(array('a', 'b', 'c', 'd', 'e'), CAST(id % 5 AS INT) + 1) AS c_mktsegment FROM range(60)",
    "orders": "SELECT id AS o_orderkey, id * id % 60 AS o_custkey, CAST(id * 911 % 5000 AS DOUBLE) AS o_totalprice FROM range(500)",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory) -> Path:
    path = tmp_path_factory.mktemp("tables")
    for name, sql in TABLES.items():
        spark.sql(sql).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["a19_neuron_effect", "t2_top_neurons", "a20_debug_report"])
def test_grid_is_neither_shuffled_by_neuron_nor_planned_from_the_tables(spark, tables, name):
    """One task per neuron would hold the rows of the whole table; the tables' plan would stand in it several times."""
    done = QUERIES[name](spark, str(tables))
    assert done.count() > 0
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan
    assert not re.search(r"hashpartitioning\(force#\d+, neuron#\d+", plan)
