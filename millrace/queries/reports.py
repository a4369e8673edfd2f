"""Reports over run, job, access-log and role tables derived from the given ones."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace import messages
from millrace.functions.paths import s3_paths
from millrace.operators import access, audit, jobs, runs
from millrace.operators.sinks import write_parquet
from millrace.queries.common import scratch, session_with_tables

# Derived tables, the same text in both engines unless a placeholder says otherwise.
_RUNS = """
SELECT o_orderkey AS id, 'p' || CAST(o_custkey AS STRING) AS pipeline_name,
       CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'skipped' END AS status,
       o_orderdate AS started_at, o_orderdate + {span} AS finished_at
FROM orders
"""
_SPAN = "CAST(round(o_totalprice * 10000) AS BIGINT) + 7"
RUNS_SPARK = _RUNS.format(
    span=f"make_dt_interval(0, 0, 0, CAST(({_SPAN}) / CAST(1000000 AS DECIMAL(7,0)) AS DECIMAL(18,6)))")
RUNS_DUCK = f"({_RUNS.format(span=f'to_microseconds({_SPAN})')})"

_LOG = """
SELECT event_id AS id, ts AS timestamp, 'u' || CAST(user_id AS STRING) AS username,
       event_type AS action, CASE WHEN value > 100 THEN 'pipeline' WHEN value > 20 THEN 'role'
                                  WHEN value > 10 THEN '' END AS target_type
FROM events
"""

_JOBS = """
SELECT event_id AS id, 'p' || CAST(user_id AS STRING) AS pipeline,
       CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued'
                       WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running'
                       ELSE 'success' END AS status,
       CASE WHEN value > 60 THEN 3 WHEN value > 25 THEN 2 ELSE 1 END AS attempts, 3 AS max_attempts,
       'manual' AS trigger, ts AS enqueued_at, ts AS run_after, ts AS started_at,
       CASE WHEN event_type = 'view' THEN ts + INTERVAL 1 DAY END AS heartbeat_at,
       CAST(NULL AS TIMESTAMP) AS finished_at, user_id AS worker_pid,
       CAST(NULL AS STRING) AS error_message
FROM events
"""
_NOW = datetime(2024, 1, 20)
_NOW_SQL = "TIMESTAMP '2024-01-20 00:00:00'"

_PATHS = """
SELECT event_id, 'role_' || CAST(user_id % 30 AS STRING) AS role,
       CASE event_type WHEN 'view' THEN '/local/' WHEN 'click' THEN 'S3://bucket-' ELSE 's3://bucket-' END
       || CAST(event_id % 5 AS STRING)
       || CASE event_type WHEN 'error' THEN '/private/' WHEN 'click' THEN '/private/' ELSE '/data/' END
       || CAST(user_id AS STRING) AS path
FROM events
"""
_ROLES = """
SELECT 'role_' || CAST(n_nationkey AS STRING) AS name,
       {array}(CASE WHEN n_nationkey = 0 THEN '*' ELSE 'query.run' END){end} AS permissions,
       CASE WHEN n_nationkey = 7 THEN {array}(''){end}
            WHEN n_nationkey < 10 THEN {empty}
            ELSE {array}('s3://bucket-' || CAST(n_regionkey AS STRING) || '/'){end} END AS allow,
       {array}('s3://bucket-' || CAST(n_regionkey AS STRING) || '/private/', ''){end} AS deny
FROM nation
"""
ROLES_SPARK = _ROLES.format(array="array", end="", empty="CAST(array() AS ARRAY<STRING>)")
ROLES_DUCK = f"({_ROLES.format(array='list_value', end='', empty='CAST([] AS VARCHAR[])')})"

_TEXTS = """
SELECT event_id, role, 'SELECT * FROM read_parquet(''' || path || '/a.parquet''), "' || path
       || ';x" -- S3://x/' || role AS text
FROM ({paths}) t
"""

_CUSTOMER_ROLES = """
SELECT 'c' || CAST(c_custkey AS STRING) AS name,
       CASE WHEN c_acctbal < 0 THEN {array}('*')
            ELSE {array}('dashboard.view', 'query.run', 'query.run',
                         'pipelines.' || lower(c_mktsegment)) END AS permissions
FROM customer
"""


def _table(spark, folder, text, tables=("orders", "events", "nation", "customer")):
    return session_with_tables(spark, folder, tables).sql(text)


def _two(spark, folder, *texts):
    session = session_with_tables(spark, folder, ["events", "nation", "customer", "orders"])
    return [session.sql(text) for text in texts]


def retention_prune(spark, folder):
    session = session_with_tables(spark, folder, ["events"])
    path = scratch(spark, "log")
    write_parquet(session.sql(_LOG), path)
    dropped = audit.prune(session, path, 10, now=_NOW)
    return session.read.parquet(path).select("id", "action", F.lit(dropped).cast("bigint").alias("dropped"))


def retention_days(spark, folder):
    """The same on a log kept in day folders: expired folders are dropped whole."""
    session = session_with_tables(spark, folder, ["events"])
    path = scratch(spark, "log-days")
    write_parquet(session.sql(f"SELECT *, CAST(timestamp AS DATE) AS day FROM ({_LOG})"), path,
                  partition_by="day")
    dropped = audit.prune(session, path, 10, now=_NOW, partition_by="day")
    return session.read.parquet(path).select("id", "action", F.lit(dropped).cast("bigint").alias("dropped"))


def stale_jobs(spark, folder):
    moved = jobs.recover_stale(_table(spark, folder, _JOBS), F.lit(str(_NOW)).cast("timestamp_ntz"),
                               stale_seconds=5 * 86400)
    return moved.select("id", "status", "trigger", "run_after", "heartbeat_at", "finished_at",
                        "worker_pid", "error_message", "recovered")


def retry_decision(spark, folder):
    df = _table(spark, folder, f"""
        SELECT *, CASE WHEN status = 'running' THEN CASE WHEN value_band > 1 THEN 'failed'
                                                         ELSE 'success' END END AS outcome,
               CASE WHEN status = 'running' AND value_band > 1 THEN 'boom' END AS outcome_message
        FROM (SELECT *, attempts AS value_band FROM ({_JOBS}))
    """)
    moved = jobs.finish_jobs(df, F.lit(str(_NOW)).cast("timestamp_ntz"), retry_delay_seconds=90)
    return moved.select("id", "status", "trigger", "run_after", "finished_at", "error_message")


def runnable(spark, folder):
    df = jobs.runnable_jobs(_table(spark, folder, _JOBS), F.lit(str(_NOW)).cast("timestamp_ntz"), 5, "id")
    return df.select("id", "pipeline", "enqueued_at")


_REQUESTS = "SELECT c_custkey AS request, 'p' || CAST(c_custkey AS STRING) AS pipeline FROM customer"


def enqueue_dedupe(spark, folder):
    requests, table = _two(spark, folder, _REQUESTS, _JOBS)
    return jobs.new_requests(requests, table).select("request", "pipeline")


def active_requests(spark, folder):
    requests, table = _two(spark, folder, _REQUESTS, _JOBS)
    return jobs.active_requests(requests, table).select("request", "pipeline")


def scope_join(spark, folder):
    return access.scope_paths(*_two(spark, folder, _PATHS, ROLES_SPARK))


_STEPPED = """
SELECT event_id, 'role_' || CAST(user_id % 30 AS STRING) AS role, event_type AS kind,
       's3://bucket-' || CAST(event_id % 5 AS STRING) AS bucket, CAST(user_id AS STRING) AS name
FROM events
"""
# How a path is written, and the object that it names, by the kind of event.
_WRITTEN = """bucket || CASE kind WHEN 'view' THEN '/data/../private/' WHEN 'click' THEN '//private//'
    WHEN 'error' THEN '/private/../data/./' WHEN 'signup' THEN '/data/x/y/../../../private/' ELSE '/data/../../private/' END || name"""
_NAMED_BY_IT = "bucket || CASE kind WHEN 'error' THEN '/data/' ELSE '/private/' END || name"


def scope_steps(spark, folder):
    """Paths with dot steps and doubled slashes: judged by the object they name."""
    paths, roles = _two(spark, folder, f"SELECT event_id, role, {_WRITTEN} AS path FROM ({_STEPPED})", ROLES_SPARK)
    return access.scope_paths(paths, roles)


def scope_denied_report(spark, folder):
    return access.denied_report(*_two(spark, folder, _TEXTS.format(paths=_PATHS), ROLES_SPARK))


def extract_paths(spark, folder):
    texts = _table(spark, folder, _TEXTS.format(paths=_PATHS))
    return texts.select("event_id", F.explode(s3_paths(F.col("text"))).alias("path"))


def role_permissions(spark, folder):
    return access.expand_permissions(_table(spark, folder, _CUSTOMER_ROLES.format(array="array")))


def permission_holders(spark, folder):
    users, roles = _two(
        spark, folder, "SELECT o_orderkey AS id, 'c' || CAST(o_custkey AS STRING) AS role FROM orders",
        _CUSTOMER_ROLES.format(array="array"))
    return access.with_permission(users, roles, "settings.manage").select("id", "role")


_NORMAL = "regexp_replace(path, '^(?i)s3://', 's3://')"
_ALLOWED = """
    NOT starts_with(p, 's3://') OR coalesce(list_contains(permissions, '*'), false)
    OR (NOT coalesce(len(list_filter(deny, lambda d: d <> '' AND starts_with(p, d))) > 0, false)
        AND (coalesce(len(allow), 0) = 0
             OR len(list_filter(allow, lambda a: a <> '' AND starts_with(p, a))) > 0))
"""
_TEXTS_DUCK = f"({_TEXTS.format(paths=_PATHS)})"
_FOUND = f"""
    SELECT event_id, role, unnest(regexp_extract_all(text, 's3://[^\\s''"();,]+', 0, 'i')) AS path
    FROM {_TEXTS_DUCK}
"""
_SCOPED = f"""
    SELECT t.*, {_ALLOWED} AS allowed
    FROM (SELECT *, regexp_replace(path, '^s3://', 's3://', 'i') AS p FROM ({{paths}})) t
    LEFT JOIN {ROLES_DUCK} r ON t.role = r.name
"""
_STALE = (f"status = 'running' AND coalesce(coalesce(heartbeat_at, started_at) < {_NOW_SQL} - INTERVAL 5 DAY,"
          " false)")
_PERMISSION_LIST = ", ".join(f"'{p}'" for p in access.ALL_PERMISSIONS)
_GRANTED = f"""
    SELECT DISTINCT name AS role, unnest(CASE WHEN list_contains(permissions, '*')
           THEN [{_PERMISSION_LIST}] ELSE permissions END) AS permission
    FROM ({_CUSTOMER_ROLES.format(array='list_value')})
"""

QUERIES = {
    "status_counts": (
        lambda spark, folder: runs.status_counts(_table(spark, folder, RUNS_SPARK)),
        f"""SELECT coalesce(status, 'total_runs') AS status, CAST(sum(runs) AS BIGINT) AS runs FROM (
              SELECT status, count(*) AS runs FROM {RUNS_DUCK} GROUP BY 1
              UNION ALL SELECT unnest(['success', 'failed', 'started']), 0)
            GROUP BY ROLLUP (status)""",
    ),
    "recent_runs": (
        lambda spark, folder: runs.recent_runs(_table(spark, folder, RUNS_SPARK), 15, "id"),
        f"""SELECT *, round(epoch_us(finished_at - started_at) / 1e6, 1) AS duration
            FROM {RUNS_DUCK} ORDER BY started_at DESC, id LIMIT 15""",
    ),
    "history_one": (
        lambda spark, folder: runs.history(_table(spark, folder, RUNS_SPARK), "p7", 20, "id"),
        f"SELECT * FROM {RUNS_DUCK} WHERE pipeline_name = 'p7' ORDER BY started_at DESC, id LIMIT 20",
    ),
    "history_topn": (
        lambda spark, folder: runs.history_of_all(_table(spark, folder, RUNS_SPARK), 5, "id")
        .withColumn("position", F.col("position").cast("bigint")),
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_name
              ORDER BY started_at DESC, id) AS position FROM {RUNS_DUCK}) WHERE position <= 5""",
    ),
    "last_success": (
        lambda spark, folder: runs.last_success(_table(spark, folder, RUNS_SPARK)),
        f"""SELECT pipeline_name, max(finished_at) AS finished_at FROM {RUNS_DUCK}
            WHERE status = 'success' GROUP BY 1""",
    ),
    "run_durations": (
        lambda spark, folder: _table(spark, folder, RUNS_SPARK).select(
            "id", runs.duration_seconds("started_at", "finished_at").alias("duration")),
        f"SELECT id, round(epoch_us(finished_at - started_at) / 1e6, 1) AS duration FROM {RUNS_DUCK}",
    ),
    "audit_search": (
        lambda spark, folder: audit.audit_search(
            _table(spark, folder, _LOG), action="click", target_type="role", limit=900, offset=30),
        f"""SELECT * FROM ({_LOG}) WHERE action = 'click' AND target_type = 'role'
            ORDER BY timestamp DESC, id LIMIT 900 OFFSET 30""",
    ),
    "audit_facets": (
        lambda spark, folder: audit.facets(_table(spark, folder, _LOG)),
        f"""SELECT DISTINCT facet, value FROM (
              SELECT 'action' AS facet, action AS value FROM ({_LOG})
              UNION ALL SELECT 'target_type', target_type FROM ({_LOG}))
            WHERE value IS NOT NULL AND value <> ''""",
    ),
    "retention_prune": (
        retention_prune,
        f"""SELECT id, action, (SELECT count(*) FROM ({_LOG})
                                WHERE timestamp < {_NOW_SQL} - INTERVAL 10 DAY) AS dropped
            FROM ({_LOG}) WHERE timestamp >= {_NOW_SQL} - INTERVAL 10 DAY""",
    ),
    "retention_days": (
        retention_days,
        f"""SELECT id, action, (SELECT count(*) FROM ({_LOG})
                                WHERE CAST(timestamp AS DATE) < DATE '2024-01-10') AS dropped
            FROM ({_LOG}) WHERE CAST(timestamp AS DATE) >= DATE '2024-01-10'""",
    ),
    "stale_jobs": (
        stale_jobs,
        f"""SELECT id,
              CASE WHEN stale AND attempts < max_attempts THEN 'queued' WHEN stale THEN 'failed'
                   ELSE status END AS status,
              CASE WHEN stale AND attempts < max_attempts THEN 'retry' ELSE trigger END AS trigger,
              CASE WHEN stale AND attempts < max_attempts THEN {_NOW_SQL} ELSE run_after END AS run_after,
              CASE WHEN NOT (stale AND attempts < max_attempts) THEN heartbeat_at END AS heartbeat_at,
              CASE WHEN stale AND attempts >= max_attempts THEN {_NOW_SQL} END AS finished_at,
              CASE WHEN NOT (stale AND attempts < max_attempts) THEN worker_pid END AS worker_pid,
              CASE WHEN stale AND attempts < max_attempts THEN '{messages.REQUEUED}'
                   WHEN stale THEN '{messages.EXHAUSTED}' END AS error_message,
              stale AS recovered
            FROM (SELECT *, {_STALE} AS stale FROM ({_JOBS}))""",
    ),
    "retry_decision": (
        retry_decision,
        f"""SELECT id,
              CASE WHEN status <> 'running' THEN status WHEN attempts = 1 THEN 'success'
                   WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END AS status,
              CASE WHEN status = 'running' AND attempts = 2 THEN 'retry' ELSE trigger END AS trigger,
              CASE WHEN status = 'running' AND attempts = 2 THEN {_NOW_SQL} + INTERVAL 90 SECOND
                   ELSE run_after END AS run_after,
              CASE WHEN status = 'running' AND attempts <> 2 THEN {_NOW_SQL} END AS finished_at,
              CASE WHEN status = 'running' AND attempts > 1 THEN 'boom' END AS error_message
            FROM ({_JOBS})""",
    ),
    "runnable_jobs": (
        runnable,
        f"""SELECT id, pipeline, enqueued_at FROM ({_JOBS}) WHERE status = 'queued'
            AND run_after <= {_NOW_SQL} ORDER BY enqueued_at, id LIMIT 5""",
    ),
    "recent_jobs": (
        lambda spark, folder: jobs.recent_jobs(_table(spark, folder, _JOBS), 50, "id").select(
            "id", "pipeline", "enqueued_at"),
        f"SELECT id, pipeline, enqueued_at FROM ({_JOBS}) ORDER BY enqueued_at DESC, id LIMIT 50",
    ),
    "enqueue_dedupe": (
        enqueue_dedupe,
        f"""SELECT * FROM ({_REQUESTS}) WHERE pipeline NOT IN
            (SELECT pipeline FROM ({_JOBS}) WHERE status IN ('queued', 'running'))""",
    ),
    "active_requests": (
        active_requests,
        f"""SELECT * FROM ({_REQUESTS}) WHERE pipeline IN
            (SELECT pipeline FROM ({_JOBS}) WHERE status IN ('queued', 'running'))""",
    ),
    "scope_join": (
        scope_join,
        f"SELECT event_id, role, path, allowed FROM ({_SCOPED.format(paths=_PATHS)})",
    ),
    "scope_steps": (
        scope_steps,
        f"""SELECT s.event_id, s.role, {_WRITTEN} AS path, j.allowed FROM ({_STEPPED}) s JOIN
            ({_SCOPED.format(paths=f"SELECT event_id, role, {_NAMED_BY_IT} AS path FROM ({_STEPPED}) o")}) j
            ON s.event_id = j.event_id""",
    ),
    "scope_denied_report": (
        scope_denied_report,
        f"SELECT DISTINCT role, path FROM ({_SCOPED.format(paths=_FOUND)}) WHERE NOT allowed",
    ),
    "extract_paths": (extract_paths, f"SELECT event_id, path FROM ({_FOUND})"),
    "role_permissions": (role_permissions, _GRANTED),
    "permission_holders": (
        permission_holders,
        f"""SELECT o_orderkey AS id, 'c' || o_custkey AS role FROM orders
            WHERE 'c' || o_custkey IN (SELECT role FROM ({_GRANTED})
                                       WHERE permission = 'settings.manage')""",
    ),
}
