"""Every query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from millrace.queries import all_oracles, all_queries
from tests.compare import compare_frame, oracle
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


def test_every_query_has_an_oracle():
    assert all_queries().keys() == all_oracles().keys()
    assert all_queries().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert compare_frame(df, con, name) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["segment", "revenue", "orders", "customers"] and df.count() == 5
