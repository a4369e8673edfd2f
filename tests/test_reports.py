from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions.paths import s3_paths
from millrace.operators import access, audit, jobs, runs
from tests.conftest import rows

NOW = datetime(2026, 7, 16, 12)


def at(**back):
    return NOW - timedelta(**back)


def moment():
    return F.lit(str(NOW)).cast("timestamp_ntz")


@pytest.fixture
def run_table(spark):
    return spark.createDataFrame([
        (1, "a", "success", at(hours=9), at(hours=9) + timedelta(seconds=12.34)),
        (2, "a", "failed", at(hours=5), at(hours=4)),
        (3, "b", "success", at(hours=3), at(hours=2)),
        (4, "b", "odd", at(hours=1), None),
        (5, "a", "success", at(hours=2), at(hours=1)),
    ], "id long, pipeline_name string, status string, started_at timestamp_ntz, "
       "finished_at timestamp_ntz")


def test_status_counts(run_table):
    assert dict(rows(runs.status_counts(run_table))) == {
        "success": 3, "failed": 1, "started": 0, "odd": 1, "total_runs": 5}
    assert dict(rows(runs.status_counts(run_table.where("false")))) == {
        "success": 0, "failed": 0, "started": 0, "total_runs": 0}


def test_recent_history_and_last_success(run_table):
    recent = runs.recent_runs(run_table, 2).select("id", "duration")
    assert [tuple(r) for r in recent.collect()] == [(4, None), (5, 3600.0)]
    assert runs.recent_runs(run_table).where("id = 1").first()["duration"] == 12.3
    assert [r["id"] for r in runs.history(run_table, "a", 2).collect()] == [5, 2]
    top = runs.history_of_all(run_table, 2).select("pipeline_name", "position", "id")
    assert rows(top) == [("a", 1, 5), ("a", 2, 2), ("b", 1, 4), ("b", 2, 3)]
    assert rows(runs.last_success(run_table)) == [("a", at(hours=1)), ("b", at(hours=2))]


@pytest.fixture
def log(spark):
    return spark.createDataFrame([
        (1, at(days=200), "ann", "role.delete", "role"),
        (2, at(days=3), "ann", "login", None),
        (3, at(days=2), "bob", "login", ""),
        (4, at(days=1), "ann", "role.create", "role"),
    ], "id long, timestamp timestamp_ntz, username string, action string, target_type string")


def test_audit_search(log):
    def found(**filters):
        return [r["id"] for r in audit.audit_search(log, **filters).collect()]

    assert found() == [4, 3, 2, 1]
    assert found(username="ann") == [4, 2, 1]
    assert found(username="ann", target_type="role", limit=1) == [4]
    assert found(action="login", limit=0) == [3]
    assert found(offset=3) == [1] and found(offset=-2, limit=2) == [4, 3]


def test_facets(log):
    assert [tuple(r) for r in audit.facets(log).collect()] == [
        ("action", "login"), ("action", "role.create"), ("action", "role.delete"),
        ("target_type", "role")]


def test_prune(spark, log, tmp_path):
    path = str(tmp_path / "log")
    log.write.parquet(path)
    for days, dropped, left in [(0, 0, 4), (-1, 0, 4), (90, 1, 3), (90, 0, 3)]:
        assert audit.prune(spark, path, days, now=NOW) == dropped
        assert spark.read.parquet(path).count() == left


JOBS = ("pipeline string, status string, attempts int, max_attempts int, started_at timestamp_ntz, "
        "heartbeat_at timestamp_ntz, enqueued_at timestamp_ntz, run_after timestamp_ntz, "
        "trigger string, worker_pid long, finished_at timestamp_ntz, error_message string")


def job(pipeline, status, attempts, most, started, beat, pid=1):
    return (pipeline, status, attempts, most, started, beat, at(hours=1), at(hours=1), "manual", pid,
            None, None)


@pytest.mark.parametrize("silent, status, attempts, most, becomes", [
    (61, "running", 1, 2, "queued"),
    (59, "running", 1, 2, "running"),
    (86_400, "running", 4, 9, "queued"),
    (86_400, "running", 9, 9, "failed"),
    (86_400, "success", 1, 9, "success"),
    (86_400, "queued", 0, 9, "queued"),
])
def test_silent_jobs(spark, silent, status, attempts, most, becomes):
    """Silence is counted from the last sign of life, else from the start."""
    since = at(seconds=silent)
    table = spark.createDataFrame([
        job("beats", status, attempts, most, at(days=30), since),
        job("never_beat", status, attempts, most, since, None)], JOBS)
    for row in jobs.recover_stale(table, moment(), 60).collect():
        changed = status == "running" and becomes != "running"
        assert (row["status"], row["recovered"]) == (becomes, changed)
        assert (row["error_message"] is not None) == changed
        assert row["worker_pid"] == (None if changed and becomes == "queued" else 1)
        assert row["finished_at"] == (NOW if changed and becomes == "failed" else None)


def test_a_job_without_any_time_is_left_alone(spark):
    table = spark.createDataFrame([job("odd", "running", 1, 2, None, None)], JOBS)
    assert jobs.recover_stale(table, moment(), 60).first()["status"] == "running"


def test_finish_decides_on_retry(spark):
    df = spark.createDataFrame([
        job("again", "running", 1, 2, NOW, NOW), job("over", "running", 2, 2, NOW, NOW),
        job("fine", "running", 1, 2, NOW, NOW), job("open", "running", 1, 2, NOW, NOW)], JOBS)
    outcome = F.when(F.col("pipeline").isin("again", "over"), "failed").when(
        F.col("pipeline") == "fine", "success")
    df = df.withColumn("outcome", outcome).withColumn("outcome_message", F.lit("why"))
    got = {r["pipeline"]: r for r in jobs.finish_jobs(df, moment(), 60).collect()}
    assert (got["again"]["status"], got["again"]["trigger"]) == ("queued", "retry")
    assert got["again"]["run_after"] == NOW + timedelta(seconds=60)
    assert (got["over"]["status"], got["over"]["finished_at"]) == ("failed", NOW)
    assert (got["fine"]["status"], got["open"]["status"]) == ("success", "running")
    assert got["open"]["error_message"] is None and got["again"]["error_message"] == "why"


def test_runnable_and_dedupe(spark):
    table = spark.createDataFrame([
        job("a", "queued", 0, 1, None, None), job("b", "running", 1, 1, NOW, NOW),
        job("c", "success", 1, 1, NOW, NOW)], JOBS)
    assert [r["pipeline"] for r in jobs.runnable_jobs(table, moment()).collect()] == ["a"]
    early = F.lit(str(at(hours=2))).cast("timestamp_ntz")
    assert jobs.runnable_jobs(table, early).count() == 0
    requests = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "pipeline string")
    assert rows(jobs.new_requests(requests, table)) == [("c",), ("d",)]
    assert rows(jobs.active_requests(requests, table)) == [("a",), ("b",)]


def scope(spark, permissions, allow, deny, paths):
    roles = spark.createDataFrame([("r", permissions, allow, deny)], access.ROLES_DDL)
    return access.denied_paths(spark, roles, "r", paths)


ALLOW, DENY = ["s3://allowed-bucket/"], ["s3://allowed-bucket/private/"]


def test_scope_of_the_object_a_path_names(spark):
    allow, deny = ["s3://b/pub/"], ["s3a://b//pub/./secret/"]
    out = ["s3://b/pub/../private/x", "s3a://b/pub/a/../../private/x", "s3://b//private/x", "s3://b/pub/secret/x",
           "s3n://b/pub//secret/x", "s3://b/pub/a/../secret/x", "s3://b/pub/{../private,x}/y", "s3://b/pub/..",
           "s3://b/../../private/x"]
    inside = ["s3://b//pub/x", "s3://b/private/../pub/x", "s3://b/./pub/x/", "s3://b/pub/a..b/x", "s3://b/pub/{x,y}.csv",
              "/pub/../private", "s3://b/pub/x/..", "s3://b/../pub/x"]
    assert scope(spark, [], allow, deny, out + inside) == out
    assert scope(spark, ["*"], allow, deny, out) == []


def test_scope_rules(spark):
    paths = ["s3://allowed-bucket/x", "s3://allowed-bucket/private/y", "s3://other/z", "/local/w"]
    assert scope(spark, [], ALLOW, DENY, paths) == paths[1:3]
    assert scope(spark, ["*"], ALLOW, DENY, paths) == []
    assert scope(spark, [], [], DENY, paths) == paths[1:2]
    assert scope(spark, None, None, None, paths) == []
    assert scope(spark, [], [""], [""], paths) == paths[:3]
    assert scope(spark, [], ALLOW, [], ["S3://allowed-bucket/x", "S3://other/z"]) == ["S3://other/z"]
    assert scope(spark, [], [], ["S3://allowed-bucket/"], ["s3://allowed-bucket/x"]) != []
    assert access.denied_paths(
        spark, spark.createDataFrame([("r", [], ALLOW, [])], access.ROLES_DDL), "nobody", paths) == []


def test_path_extraction(spark):
    text = "SELECT * FROM read_parquet('s3://b1/a/*.parquet') JOIN \"S3://b2/x\";(s3://c,d)"
    df = spark.createDataFrame([(text,), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(s3_paths(F.col("t"))).collect()]
    assert got == [["s3://b1/a/*.parquet", "S3://b2/x", "s3://c"], [], []]


def test_permissions(spark):
    roles = spark.createDataFrame(
        [("admin", ["query.run", "*"]), ("viewer", ["query.run", "query.run"]), ("none", [])],
        "name string, permissions array<string>")
    expanded = access.expand_permissions(roles)
    assert expanded.where("role = 'admin'").count() == len(access.ALL_PERMISSIONS)
    assert rows(expanded.where("role <> 'admin'")) == [("viewer", "query.run")]
    users = spark.createDataFrame([("u", "viewer"), ("v", "admin")], "user string, role string")
    assert rows(access.with_permission(users, roles, "audit.view").select("user")) == [("v",)]


def test_prune_keeps_the_layout_and_what_has_not_expired(spark, tmp_path):
    path = str(tmp_path / "parted")
    entries = [(1, at(days=400), "a/b"), (2, at(days=1), "a/b"), (3, at(days=400), "old c"),
               (4, at(days=2), "new"), (5, None, "new")]
    table = spark.createDataFrame(entries, "id long, timestamp timestamp_ntz, kind string")
    table.coalesce(1).write.partitionBy("kind").parquet(path)
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "parted" / "kind=new").glob("part-*")}
    assert audit.prune(spark, path, 90, now=NOW) == 2
    left = spark.read.parquet(path).select("id", "kind")
    assert [tuple(r) for r in left.orderBy("id").collect()] == [(2, "a/b"), (4, "new"), (5, "new")]
    assert {p: p.stat().st_mtime_ns for p in untouched} == untouched
    assert audit.prune(spark, path, 90, now=NOW) == 0
