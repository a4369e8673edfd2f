from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark import TaskContext

from millrace.errors import PluginError
from millrace.operators.plugins import PluginRegistry, StagedPlugin, plugin_step, row_chunks
from tests.conftest import rows


def plus(table, params):
    """Adds, and tells odd numbers: two columns from one."""
    total = pc.add(table["n"], params["add"])
    return pa.table({"total": total, "odd": pc.equal(pc.bit_wise_and(total, 1), 1)})


def size(table, params):
    return pa.table({"rows": pa.array([table.num_rows], pa.int64())})


def sizes_by_key(table, params):
    keys = table["k"].unique()
    if len(keys) > 1:
        raise ValueError("two groups in one call")
    return pa.table({"k": pa.array([keys[0].as_py() if len(keys) else None], pa.int64()),
                     "rows": pa.array([table.num_rows], pa.int64())})


PLUGINS = PluginRegistry({"plus": plus, "size": size, "by_key": sizes_by_key,
                          "wrong": lambda t, p: [1], "text": lambda t, p: "x"})


def run(df, **step):
    return plugin_step(df, {"type": "python", **step}, PLUGINS)


@pytest.fixture
def eight(spark):
    return spark.range(8).withColumnRenamed("id", "n")


def test_row_wise(spark):
    df = spark.createDataFrame([(-4,), (6,), (0,)], "n long")
    assert rows(run(df, function="plus", params={"add": 1}, mode="chunk")) == [
        (-3, True), (1, True), (7, True)]


def test_chunks_are_bounded_and_complete(eight):
    df = run(eight, function="plus", params={"add": 100}, chunk_rows=3)
    assert [r[0] for r in rows(df)] == list(range(100, 108))
    sizes = [r[0] for r in rows(run(eight.coalesce(1), function="size", chunk_rows=3))]
    assert sizes == [2, 3, 3]


def test_exact_slices_of_a_file(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.range(5_300).withColumnRenamed("id", "n").coalesce(1).write.parquet(path)
    df = row_chunks(spark.read.parquet(path), "size", size, {}, 2048)
    assert [r[0] for r in rows(df)] == [1204, 2048, 2048]


def test_slices_together_are_the_whole_file(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.range(40).withColumnRenamed("id", "n").coalesce(1).write.parquet(path)
    df = row_chunks(spark.read.parquet(path), "plus", plus, {"add": 0}, 7)
    assert rows(df) == [(n, n % 2 == 1) for n in range(40)]


def test_empty_input_keeps_the_plugin_schema(spark):
    empty = spark.createDataFrame([], "n long")
    df = run(empty, function="plus", params={"add": 1}, mode="chunk")
    assert df.columns == ["total", "odd"] and df.count() == 0


def test_groups_are_not_mixed_and_large_ones_are_cut(spark):
    data = [(1,)] * 95 + [(2,)] * 3 + [(None,)] * 4 + [(3,)] * 10
    df = spark.createDataFrame(data, "k long").repartition(5)
    got = rows(run(df, function="by_key", group_by=["k"], chunk_rows=10, pieces=True))
    totals = {}
    for key, n in got:
        assert n <= 10
        totals[key] = totals.get(key, 0) + n
    assert totals == {1: 95, 2: 3, None: 4, 3: 10}
    assert (2, 3) in got and (None, 4) in got and (3, 10) in got


def total(table, params):
    return pa.table({"sum": pa.array([pc.sum(table["v"]).as_py() or 0], pa.int64())})


def add(states, params):
    return pa.table({"sum": pa.array([pc.sum(states["sum"]).as_py() or 0], pa.int64())})


def of_sum(table, params):
    return table.select(["k", "v", "sum"])


STAGED = PluginRegistry({"part": StagedPlugin(total, add, of_sum)})


def test_staged_groups_see_all_their_rows(spark):
    nan = float("nan")
    data = [(1.0, i) for i in range(3000)] + [(nan, 1)] * 700 + [(None, 2)] * 50 + [(4.0, 5)]
    df = spark.createDataFrame(data, "k double, v long").repartition(6)
    got = plugin_step(df, {"function": "part", "group_by": ["k"], "chunk_rows": 100}, STAGED).collect()
    assert len(got) == len(data)
    sums = {str(r["k"]): r["sum"] for r in got}
    assert sums == {"1.0": sum(range(3000)), "nan": 700, "None": 100, "4.0": 5}
    assert len({(str(r["k"]), r["sum"]) for r in got}) == 4
    whole = plugin_step(df, {"function": "part"}, STAGED).collect()
    assert len(whole) == len(data) and {r["sum"] for r in whole} == {sum(range(3000)) + 805}
    assert plugin_step(df.limit(0), {"function": "part"}, STAGED).count() == 0
    assert plugin_step(df.limit(0), {"function": "part", "group_by": ["k"]}, STAGED).count() == 0


@pytest.mark.parametrize("settings", [{}, {"group_by": ["n"]}])
def test_a_plain_plugin_is_not_given_a_whole_group(eight, settings):
    with pytest.raises(PluginError, match="must be a StagedPlugin"):
        run(eight, function="size", **settings)


def test_lookup_errors(eight):
    with pytest.raises(PluginError, match="Invalid plugin name"):
        PLUGINS.load("Bad Name")
    with pytest.raises(PluginError, match="Unknown transform plugin 'missing'. Available: by_key"):
        run(eight, function="missing")
    with pytest.raises(PluginError, match="does not expose a callable"):
        PluginRegistry({"thing": 3}).load("thing")
    with pytest.raises(PluginError, match="must return a pyarrow.Table, got list"):
        run(eight, function="wrong", chunk_rows=5)


def test_slices_with_another_schema_fail(spark):
    def unsteady(table, params):
        return table if table.num_rows == 0 else table.rename_columns(["other"])

    df = plugin_step(spark.range(3), {"type": "python", "function": "unsteady", "chunk_rows": 9},
                     PluginRegistry({"unsteady": unsteady}))
    with pytest.raises(Exception, match="all slices must have one schema"):
        df.collect()


def test_declared_schema_is_used(spark):
    df = plugin_step(spark.range(3), {"type": "python", "function": "same", "schema": "id double", "chunk_rows": 9},
                     PluginRegistry({"same": lambda t, p: t}))
    assert rows(df) == [(0.0,), (1.0,), (2.0,)]


def test_a_state_of_any_type_in_both_modes(spark):
    kind = pa.list_(pa.struct([("k", pa.float64()), ("n", pa.int64())]))

    def seen(ks, ns):
        counts = {}
        for k, n in zip(ks, ns):
            counts[k] = counts.get(k, 0) + n
        return pa.table({"seen": pa.array([[{"k": k, "n": counts[k]} for k in sorted(counts)]], kind)})

    def counted(table, params):
        return seen(table["k"].to_pylist(), [1] * table.num_rows)

    def joined(states, params):
        found = [one for state in states["seen"].to_pylist() for one in state]
        return seen([x["k"] for x in found], [x["n"] for x in found])

    def told(table, params):
        shown = [str([(x["k"], x["n"]) for x in row]) for row in table["seen"].to_pylist()]
        return table.select(["k", "v"]).append_column("shown", pa.array(shown, pa.string()))

    registry = PluginRegistry({"part": StagedPlugin(counted, joined, told)})
    df = spark.createDataFrame([(float(i % 2), i) for i in range(50)], "k double, v long").repartition(5)
    whole = plugin_step(df, {"function": "part"}, registry).collect()
    assert len(whole) == 50 and {r["shown"] for r in whole} == {"[(0.0, 25), (1.0, 25)]"}
    grouped = plugin_step(df, {"function": "part", "group_by": ["k"]}, registry).collect()
    assert {(r["k"], r["shown"]) for r in grouped} == {(0.0, "[(0.0, 25)]"), (1.0, "[(1.0, 25)]")}


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_rows_of_a_large_group_do_not_meet_in_one_task(spark, monkeypatch, threshold):
    from millrace.operators import plugins
    from millrace.session import run_session

    def told(table, params):
        task = pa.array([TaskContext.get().partitionId()] * table.num_rows, pa.int64()) if table.num_rows \
            else pa.array([], pa.int64())
        return table.select(["k", "v", "sum"]).append_column("task", task)

    monkeypatch.setattr(plugins, "GROUP_ROWS", 100, raising=False)
    session = run_session(spark, {"spark.sql.autoBroadcastJoinThreshold": threshold,
                                  "spark.sql.adaptive.autoBroadcastJoinThreshold": threshold,
                                  "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    data = [("a", i) for i in range(3000)] + [("b", 1), (None, 2), (None, 3)]
    df = session.createDataFrame(data, "k string, v long").repartition(6)
    registry = PluginRegistry({"part": StagedPlugin(total, add, told)})
    got = plugin_step(df, {"function": "part", "group_by": ["k"], "chunk_rows": 100}, registry).collect()
    assert sorted((r["k"] or "", r["v"], r["sum"]) for r in got) == sorted(
        [("a", i, sum(range(3000))) for i in range(3000)] + [("b", 1, 1), ("", 2, 5), ("", 3, 5)])
    tasks = Counter(r["task"] for r in got if r["k"] == "a")
    assert len(tasks) > 3 and max(tasks.values()) < 1500
