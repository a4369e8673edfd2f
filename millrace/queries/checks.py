"""Data-quality checks over whole tables, and the gate in front of a sink."""

from __future__ import annotations

from millrace.errors import PipelineError
from millrace.operators.checks import check_report, custom_sql_report
from millrace.plans.runner import run_pipeline
from millrace.queries.common import path_of, scratch, session_with_tables, spec, where
from millrace.session import run_session

PASSING = [
    {"type": "not_null", "columns": ["event_id", "ts"]},
    {"type": "unique", "columns": ["event_id"]},
    {"type": "row_count_min", "value": 100},
    {"type": "accepted_values", "column": "event_type",
     "values": ["view", "signup", "error", "click", "purchase"]},
]
FAILING = [
    {"type": "not_null", "columns": ["kind", "event_id"]},
    {"type": "unique", "columns": ["kind", "user_id"]},
    {"type": "row_count_min", "value": 1_000_000_000},
    {"type": "accepted_values", "column": "kind", "values": ["view", "click"]},
    {"type": "accepted_values", "column": "user_id", "values": ["1", "2", "3"]},
]
MANY_UNIQUE = [
    {"type": "unique", "columns": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                   "l_quantity", "l_shipdate"]},
    {"type": "not_null", "columns": ["l_orderkey"]},
]
CUSTOM = [
    {"type": "custom_sql", "query": "SELECT count(*) FROM output WHERE o_totalprice < 0"},
    {"type": "custom_sql", "query": "SELECT count(DISTINCT o_orderstatus) FROM output",
     "must_be": 3},
    {"type": "custom_sql", "query": "SELECT count(*) FROM output WHERE o_orderstatus = 'P'"},
]


def _report(table, columns, checks):
    def run(spark, folder):
        df = run_session(spark).read.parquet(path_of(folder, table)).selectExpr(*columns)
        return check_report(df, checks).drop("position")

    return run


def _lines(table: str, lines: list[tuple]) -> str:
    """One row per line: check, column, observed, expected, nulls, passed."""
    return " UNION ALL ".join(
        f'SELECT \'{check}\' AS "check", \'{column}\' AS "column", '
        f"CAST({observed} AS BIGINT) AS observed, CAST({expected} AS BIGINT) AS expected, "
        f"CAST({nulls} AS BIGINT) AS null_rows, {passed} AS passed FROM {table}"
        for check, column, observed, expected, nulls, passed in lines
    )


def _not_null(c):
    n = f"count(*) FILTER ({c} IS NULL)"
    return "not_null", c, n, 0, n, f"{n} = 0"


def _unique(c):
    n = f"(count(*) - count(DISTINCT {c}))"
    return "unique", c, n, 0, f"count(*) FILTER ({c} IS NULL)", f"{n} = 0"


def _accepted(c, values):
    n = f"count(*) FILTER ({c} NOT IN ({values}))"
    return "accepted_values", c, n, 0, f"count(*) FILTER ({c} IS NULL)", f"{n} = 0"


def _rows(value):
    return "row_count_min", "", "count(*)", value, 0, f"count(*) >= {value}"


def custom_sql(spark, folder):
    session = session_with_tables(spark, folder, ["orders"])
    session.table("orders").createOrReplaceTempView("output")
    rows = custom_sql_report(session, CUSTOM)
    return session.createDataFrame(
        [(i, int(observed), expected, passed) for i, (_, observed, expected, passed)
         in enumerate(rows)],
        "line bigint, observed bigint, expected bigint, passed boolean",
    )


def gate_keeps_sink(spark, folder):
    """A good run, then one whose check fails: the sink still holds the first."""
    sink = scratch(spark, "gated")
    good = spec(folder, "orders", where("o_orderstatus = 'F'"), name="gated", sink_path=sink,
                checks=[{"type": "unique", "columns": ["o_orderkey"]}])
    run_pipeline(spark, good)
    bad = {**good, "transforms": [], "checks": [{"type": "unique", "columns": ["o_custkey"]}]}
    try:
        run_pipeline(spark, bad)
    except PipelineError:
        return run_session(spark).read.parquet(sink)
    raise AssertionError("the second run should have stopped at its check")


_WITH_NULLS = ["event_id", "user_id", "NULLIF(event_type, 'error') AS kind"]
_WITH_NULLS_SQL = "(SELECT event_id, user_id, NULLIF(event_type, 'error') AS kind FROM events)"

QUERIES = {
    "check_report_pass": (
        _report("events", ["event_id", "ts", "event_type"], PASSING),
        _lines("events", [
            _not_null("event_id"), _not_null("ts"), _unique("event_id"), _rows(100),
            _accepted("event_type", "'view','signup','error','click','purchase'"),
        ]),
    ),
    "check_report_fail": (
        _report("events", _WITH_NULLS, FAILING),
        _lines(_WITH_NULLS_SQL, [
            _not_null("kind"), _not_null("event_id"), _unique("kind"), _unique("user_id"),
            _rows(1_000_000_000), _accepted("kind", "'view','click'"),
            _accepted("user_id", "'1','2','3'"),
        ]),
    ),
    "check_many_unique": (
        _report("lineitem", ["*"], MANY_UNIQUE),
        _lines("lineitem", [*map(_unique, MANY_UNIQUE[0]["columns"]), _not_null("l_orderkey")]),
    ),
    "check_custom_sql": (
        custom_sql,
        """SELECT 0::BIGINT AS line, count(*) FILTER (o_totalprice < 0) AS observed,
                  0::BIGINT AS expected, count(*) FILTER (o_totalprice < 0) = 0 AS passed FROM orders
           UNION ALL
           SELECT 1, count(DISTINCT o_orderstatus), 3, count(DISTINCT o_orderstatus) = 3 FROM orders
           UNION ALL
           SELECT 2, count(*) FILTER (o_orderstatus = 'P'), 0,
                  count(*) FILTER (o_orderstatus = 'P') = 0 FROM orders""",
    ),
    "gate_keeps_sink": (gate_keeps_sink, "SELECT * FROM orders WHERE o_orderstatus = 'F'"),
}
