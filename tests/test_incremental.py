import pytest

from millrace import PipelineError, run_incremental
from millrace.operators.access import ROLES_DDL
from millrace.operators.plugins import PluginRegistry
from millrace.streaming.incremental import read_incremental
from tests.conftest import rows


def add(spark, path, *values):
    spark.createDataFrame([(v,) for v in values], "n long").coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def made(tmp_path):
    return {"name": "inc", "source_path": str(tmp_path / "in"), "sink_path": str(tmp_path / "out"),
            "transforms": [{"type": "select", "columns": ["n * 10 AS n"]}],
            "checks": [{"type": "not_null", "columns": ["n"]}]}


def test_each_file_is_taken_once(spark, made, tmp_path):
    checkpoint = str(tmp_path / "state")
    add(spark, made["source_path"], 1, 2)
    assert run_incremental(spark, made, checkpoint).rows_written == 2
    assert run_incremental(spark, made, checkpoint).rows_written == 0
    add(spark, made["source_path"], 3)
    assert run_incremental(spark, made, checkpoint).rows_written == 1
    assert rows(read_incremental(spark, made["sink_path"])) == [(10,), (20,), (30,)]


def test_failed_check_publishes_nothing_and_is_retried(spark, made, tmp_path):
    checkpoint = str(tmp_path / "state")
    add(spark, made["source_path"], 1, None)
    with pytest.raises(PipelineError, match="not_null: 'n' has 1 null rows"):
        run_incremental(spark, made, checkpoint)
    assert not (tmp_path / "out").exists()
    fixed = {**made, "transforms": [{"type": "select", "columns": ["coalesce(n, 0) AS n"]}]}
    assert run_incremental(spark, fixed, checkpoint).rows_written == 2
    assert rows(read_incremental(spark, made["sink_path"])) == [(0,), (1,)]


def test_totals_go_on(spark, made, tmp_path):
    checkpoint = str(tmp_path / "state")
    made["transforms"] = [{"type": "aggregate", "group_by": ["n % 2 AS odd"],
                           "aggregates": ["count(*) AS c", "sum(n) AS s"]}]
    made["checks"] = []
    for values in ((1, 2, 3), (5, 6)):
        add(spark, made["source_path"], *values)
        run_incremental(spark, made, checkpoint)
    assert rows(spark.read.parquet(made["sink_path"])) == [(0, 2, 8), (1, 3, 9)]


@pytest.mark.parametrize("steps", [
    [{"type": "aggregate", "group_by": ["n"], "aggregates": ["count(*) AS c"]},
     {"type": "filter", "condition": "c > 1"}],
    [{"type": "python", "function": "f"}],
])
def test_steps_that_need_all_rows_are_refused(spark, made, tmp_path, steps):
    add(spark, made["source_path"], 1)
    with pytest.raises(ValueError):
        run_incremental(spark, {**made, "transforms": steps}, str(tmp_path / "state"))


def test_stream_joined_with_a_table_and_a_plugin(spark, made, make, tmp_path):
    names = make("names.parquet", [(1, "one")], "n long, name string")
    made["transforms"] = [
        {"type": "join", "right_path": names, "join_type": "left", "on": "left.n = right.n"},
        {"type": "python", "function": "same", "chunk_rows": 10},
        {"type": "select", "columns": ["n", "name"]},
    ]
    plugins = PluginRegistry({"same": lambda table, params: table})
    add(spark, made["source_path"], 1, 2)
    saved = {"incoming": {"config": {"path": made["source_path"]}}}
    spec = {**made, "source_path": None, "source_config": {"connector_name": "incoming"}}
    for conf in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
        try:
            run_incremental(spark, spec, str(tmp_path / f"state{conf}"), datasets=saved,
                            plugins=plugins)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert rows(read_incremental(spark, made["sink_path"])) == [(1, "one"), (2, None)]


def test_a_fresh_checkpoint_replaces_the_sink_and_the_old_one_is_refused(spark, made, tmp_path):
    for values in ((1, 2), (3,)):
        add(spark, made["source_path"], *values)
        run_incremental(spark, made, str(tmp_path / "first"))
    assert run_incremental(spark, made, str(tmp_path / "second")).rows_written == 3
    assert rows(read_incremental(spark, made["sink_path"])) == [(10,), (20,), (30,)]
    add(spark, made["source_path"], 4)
    with pytest.raises(PipelineError, match="not written from this checkpoint"):
        run_incremental(spark, made, str(tmp_path / "first"))
    run_incremental(spark, made, str(tmp_path / "second"))
    assert rows(read_incremental(spark, made["sink_path"]))[-1] == (40,)
    assert not [n for n in tmp_path.iterdir() if n.name.startswith("_")]


def test_foreign_data_is_not_replaced(spark, made, tmp_path):
    add(spark, made["source_path"], 1)
    spark.range(3).write.parquet(made["sink_path"])
    with pytest.raises(PipelineError, match="not written from this checkpoint"):
        run_incremental(spark, made, str(tmp_path / "state"))
    assert spark.read.parquet(made["sink_path"]).count() == 3


def test_settings_are_kept_or_refused(spark, made, tmp_path):
    add(spark, made["source_path"], 1, 2)
    with pytest.raises(ValueError, match="cannot keep target_file_size"):
        run_incremental(spark, {**made, "target_file_size": "1MB"}, str(tmp_path / "a"))
    run_incremental(spark, {**made, "partition_by": "k", "transforms": [
        {"type": "select", "columns": ["n", "n % 2 AS k"]}]}, str(tmp_path / "b"))
    assert len(list((tmp_path / "out").glob("batch_id=*/k=*"))) == 2
    assert rows(read_incremental(spark, made["sink_path"])) == [(1, 1), (2, 0)]


def test_roles_hold(spark, made, tmp_path):
    roles = spark.createDataFrame([("guest", [], ["s3://open/"], [])], ROLES_DDL)
    shut = {**made, "run_as": "guest", "source_path": "s3a://shut/x"}
    with pytest.raises(ValueError, match="roles table"):
        run_incremental(spark, shut, str(tmp_path / "state"))
    with pytest.raises(PermissionError, match="shut"):
        run_incremental(spark, shut, str(tmp_path / "state"), roles=roles)
