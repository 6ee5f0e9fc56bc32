"""Every registered query: against its SQL, and its plan."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
# Those of optional subpackages have tests of their own.
QUERIES = {n: q for n, q in registered.queries().items() if n in registered.own_queries()}
SQL = {name: sql for name, sql in registered.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert registered.entry(spark).count() == registered.TOP


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, FOLDER), connection, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_cross_join_and_no_row_at_a_time_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["top_normalized"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "TakeOrderedAndProject" in plan
    # A user that is NULL is one too, so no scan may leave it out.
    assert "IsNotNull(l_suppkey)" not in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan
