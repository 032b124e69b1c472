"""Every registered query against its SQL twin on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
import oracle

FOLDER = "/root/testdata/sf0.001"
# The optional part has its own tests and its own rules for plans.
QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.EXTRA}
SQL = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


def plain_spark(df):
    """No Python workers, no cross joins."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"EvalPython|InPandas|InArrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    if name in SQL:
        _, problem = oracle.compare(spark, duck, QUERIES[name], SQL[name], FOLDER, plain_spark)
        assert problem is None, problem
    else:
        assert QUERIES[name](spark, FOLDER).columns


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
