"""Every query with a SQL twin, compared row by row at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracle import compare_df, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


# Operators a plan at scale must not contain: all-pairs joins and row-wise Python.
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    assert compare_df(df, con, oracle_sql()[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [op for op in FORBIDDEN if op in plan] == []


def test_entry_is_the_store_report(spark):
    assert entry(spark).columns == ["store", "smape"] and entry(spark).count() == 10
