"""What the physical plans must look like, whatever the size of the data."""

import re

import pytest

from millrace.operators import runs
from millrace.operators.joins import join_step
from millrace.operators.steps import apply_steps
from millrace.plans.runner import pipeline_frame
from millrace.queries import all_queries
from millrace.session import run_session
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def session(spark):
    return run_session(spark)


@pytest.fixture
def big(spark):
    """A session in which nothing is small enough to broadcast."""
    return run_session(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"})


def table(session, name):
    return session.read.parquet(f"{SMALL}/{name}.parquet")


def test_filters_and_columns_reach_the_scan(session):
    text = plan(apply_steps(table(session, "lineitem"), [
        {"type": "select", "columns": ["l_orderkey", "l_quantity AS q", "l_tax"]},
        {"type": "filter", "condition": "q > 10"},
        {"type": "aggregate", "group_by": ["l_orderkey"], "aggregates": ["sum(q) AS q"]},
    ]))
    assert "GreaterThan(l_quantity,10.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_date_parameters_prune_partitions(session, tmp_path):
    path = str(tmp_path / "t")
    session.range(3).selectExpr("id", "DATE '2024-01-01' + CAST(id AS INT) AS day").write.partitionBy(
        "day").parquet(path)
    from datetime import datetime

    df = pipeline_frame(session, {
        "name": "p", "source_path": path, "sink_path": "x",
        "transforms": [{"type": "filter", "condition": "day = DATE '{{today}}'"}],
    }, now=datetime(2024, 1, 2))
    assert re.search(r"PartitionFilters: \[[^]]*day[^]]*2024-01-02", plan(df)) or re.search(
        r"PartitionFilters: \[isnotnull\(day#\d+\), \(day#\d+ = ", plan(df))
    assert df.count() == 1


def test_small_right_side_needs_no_shuffle(session):
    df = pipeline_frame(session, {
        "name": "p", "source_path": f"{SMALL}/orders.parquet", "sink_path": "x",
        "transforms": [{"type": "join", "right_path": f"{SMALL}/customer.parquet",
                        "join_type": "left", "on": "left.o_custkey = right.c_custkey"}]})
    text = plan(df)
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert text.count("FileScan") == 2


@pytest.mark.parametrize("how, extra_scans", [("left", 2), ("right", 2), ("full", 4)])
def test_large_outer_joins_salt_hot_keys_in_one_join(big, how, extra_scans):
    text = plan(join_step(table(big, "orders"), table(big, "lineitem"),
                          "left.o_orderkey = right.l_orderkey", how))
    assert text.count("SortMergeJoin") == 1
    assert re.search(r"SortMergeJoin \[o_orderkey#\d+L, _salt", text)
    # Hot keys are counted on key columns only and arrive by broadcast.
    scans = re.findall(r"ReadSchema: (struct<[^\n]*)", text)
    assert len(scans) == 2 + extra_scans
    assert sum(scan.count(":") == 1 for scan in scans) == extra_scans
    assert text.count("BroadcastHashJoin") == extra_scans


def test_no_hot_keys_are_looked_for_in_a_counted_right_side(big):
    df = pipeline_frame(big, {
        "name": "p", "source_path": f"{SMALL}/orders.parquet", "sink_path": "x",
        "transforms": [{"type": "join", "right_path": f"{SMALL}/lineitem.parquet",
                        "join_type": "left", "on": "left.o_orderkey = right.l_orderkey"}]})
    text = plan(df)
    assert "Broadcast" not in text and text.count("FileScan") == 2


@pytest.mark.parametrize("how", ["right", "full"])
def test_small_right_side_is_broadcast_in_every_join(session, how):
    text = plan(join_step(table(session, "lineitem"), table(session, "orders"),
                          "left.l_orderkey = right.o_orderkey", how, right_is_small=True))
    assert "SortMergeJoin" not in text
    assert not re.search(r"Exchange hashpartitioning\(l_orderkey[^\n]*\n[^\n]*FileScan", text)


def test_top_n_per_key_is_limited_before_the_shuffle(session):
    df = runs.history_of_all(table(session, "orders").selectExpr(
        "o_custkey AS pipeline_name", "o_orderdate AS started_at"), 3)
    text = plan(df)
    assert re.search(r"WindowGroupLimit[^\n]*Partial", text)


@pytest.mark.parametrize("name", ["recent_runs", "page_sql", "audit_search", "runnable_jobs"])
def test_first_rows_do_not_sort_everything(session, name):
    assert "TakeOrderedAndProject" in plan(all_queries()[name](session, SMALL))
