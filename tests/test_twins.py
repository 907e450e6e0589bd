"""Every registered query against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.oracle import check, connect

QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def no_pairwise_joins(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, folder, key):
    problem, _, _, _ = check(spark, con, folder, key, QUERIES, TWINS, no_pairwise_joins)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)
