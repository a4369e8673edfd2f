"""Steps, plugins and whole pipeline runs."""

from __future__ import annotations

from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc

from millrace.errors import PipelineError
from millrace.operators.plugins import PluginRegistry, StagedPlugin, row_chunks
from millrace.plans.runner import pipeline_frame, run_pipeline
from millrace.queries.common import (
    aggregate, join, path_of, saved, scratch, select, session_with_tables, spec, steps_query, where,
)
from millrace.session import run_session
from millrace.sources.synth import readings

MONEY = "CAST(CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS DOUBLE)"


def money(column: str) -> str:
    return MONEY.format(column)


# --- plugins ---------------------------------------------------------------


def discounted(table: pa.Table, params: dict) -> pa.Table:
    """Row-wise: price after discount."""
    factor = pc.subtract(pa.scalar(1.0), table["l_discount"])
    price = pc.multiply(table["l_extendedprice"], factor)
    return table.select(["l_orderkey", "l_linenumber"]).append_column("disc_price", price)


def add_constant(table: pa.Table, params: dict) -> pa.Table:
    """Row-wise; refuses a call with more rows than it was promised."""
    if table.num_rows > params["at_most"]:
        raise ValueError(f"{table.num_rows} rows in one call")
    return table.select(["event_id"]).append_column(
        "shifted", pc.add(table["user_id"], params["add"])
    )


def slice_summary(table: pa.Table, params: dict) -> pa.Table:
    """One row per call: what the slice holds."""
    ids = table["event_id"]
    bounds = pc.min_max(ids).as_py() if len(ids) else {"min": None, "max": None}
    return pa.table({
        "first_id": pa.array([bounds["min"]], pa.int64()),
        "last_id": pa.array([bounds["max"]], pa.int64()),
        "slice_rows": pa.array([len(ids)], pa.int64()),
    })


def quantity(table: pa.Table, params: dict) -> pa.Table:
    total = pc.sum(table["l_quantity"]).as_py() or 0.0
    return pa.table({"total": pa.array([total], pa.float64())})


def added(states: pa.Table, params: dict) -> pa.Table:
    return pa.table({"total": pa.array([pc.sum(states["total"]).as_py() or 0.0], pa.float64())})


def share(table: pa.Table, params: dict) -> pa.Table:
    part = pc.divide(table["l_quantity"], table["total"])
    return table.select(["l_orderkey", "l_linenumber", "l_returnflag"]).append_column("share", part)


# Needs all rows of its group: each row's part of the sum.
share_of_total = StagedPlugin(quantity, added, share)


PLUGINS = {
    "discounted": discounted,
    "add_constant": add_constant,
    "share_of_total": share_of_total,
}


def plugin(function: str, **settings) -> dict:
    return {"type": "python", "function": function, **settings}


def plugin_slices(spark, folder):
    events = run_session(spark).read.parquet(path_of(folder, "events"))
    return row_chunks(events, "slice_summary", slice_summary, {}, 3000)


# --- joins with a derived right side ---------------------------------------


def join_theta(spark, folder):
    """Months of the order calendar as ranges; a ship date falls in one at most."""
    session = session_with_tables(spark, folder, ["orders"])
    months = scratch(spark, "months") + ".parquet"
    session.sql("""
        SELECT CAST(month AS TIMESTAMP_NTZ) AS lo,
               CAST(add_months(CAST(month AS DATE), 1) AS TIMESTAMP_NTZ) AS hi
        FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS month FROM orders)
    """).coalesce(1).write.parquet(months)
    return pipeline_frame(spark, spec(
        folder, "lineitem",
        {"type": "join", "right_path": months, "join_type": "inner",
         "on": "left.l_shipdate >= right.lo AND left.l_shipdate < right.hi"},
        aggregate(["lo"], "CAST(count(*) AS BIGINT) AS n", "sum(l_quantity) AS qty"),
    ))


def join_theta_full(spark, folder):
    """Orders whose total lies in a narrow band above a customer's balance: both sides
    grow with the data, and both keep the rows that meet nobody."""
    session = session_with_tables(spark, folder, ["customer"])
    bands = scratch(spark, "bands") + ".parquet"
    session.sql("""
        SELECT c_custkey, c_acctbal * 40 AS lo, c_acctbal * 40 + 5 AS hi FROM customer
    """).write.parquet(bands)
    return pipeline_frame(spark, spec(
        folder, "orders",
        {"type": "join", "right_path": bands, "join_type": "full",
         "on": "left.o_totalprice BETWEEN right.lo AND right.hi"},
        select("o_orderkey", "c_custkey"),
    ))


def join_theta_one_bound(spark, folder):
    """Customers whose balance is at most a supplier's, by supplier, in all join types: one
    bound and no key, in tiles of some hundred rows a side."""
    made = None
    for how in ("inner", "left", "right", "full"):
        frame = pipeline_frame(spark, spec(
            folder, "customer",
            {"type": "join", "right_path": path_of(folder, "supplier"), "join_type": how, "tile_rows": 200,
             "on": "left.c_acctbal + 9000 <= right.s_acctbal"},
            aggregate([f"'{how}' AS how", "s_suppkey"], "count(c_custkey) AS n", "CAST(count(*) AS BIGINT) AS n_rows",
                      "CAST(round(sum(c_acctbal) * 100) AS BIGINT) AS cents"),
        ))
        made = frame if made is None else made.unionByName(frame)
    return made


def join_full_more(spark, folder):
    """Customers and suppliers of a nation that are far apart: few keys with many rows on
    both sides, and a second condition. Broadcasting is off and the limit of a hot key
    low, so all keys take the way of hot ones."""
    session = run_session(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"})
    return pipeline_frame(session, spec(
        folder, "customer",
        {"type": "join", "right_path": path_of(folder, "supplier"), "join_type": "full", "hot_rows": 2,
         "on": "left.`c_nationkey` = right.s_nationkey AND left.c_acctbal > right.s_acctbal + 9000"},
        select("c_custkey", "s_suppkey"),
    ))


def join_range(spark, folder):
    """Events and the user's day they fall in: as many ranges as user days."""
    session = session_with_tables(spark, folder, ["events"])
    days = scratch(spark, "user-days") + ".parquet"
    session.sql("""
        SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS lo,
               CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) + INTERVAL 1 DAY AS hi, count(*) AS n
        FROM events GROUP BY ALL
    """).write.parquet(days)
    return pipeline_frame(spark, spec(
        folder, "events",
        {"type": "join", "right_path": days, "join_type": "left",
         "on": "left.user_id = right.user_id AND left.ts >= right.lo AND left.ts < right.hi",
         "range": {"point": "ts", "low": "lo", "high": "hi", "width": 86400}},
        select("event_id", "user_id", "user_id_1", "lo", "n"),
    ))


def join_text_right(spark, folder):
    """The right side is CSV: the reader follows the extension."""
    names = scratch(spark, "names")
    session_with_tables(spark, folder, ["customer"]).table("customer").write.option(
        "header", True).csv(names)
    return pipeline_frame(spark, spec(
        folder, "orders",
        {"type": "join", "right_path": f"{names}/*.csv", "join_type": "left",
         "on": "left.o_custkey = right.c_custkey"},
        aggregate(["c_mktsegment"], "count(*) AS n", f"{money('o_totalprice')} AS total"),
    ))


# --- whole runs ------------------------------------------------------------

FLAGSHIP_STEPS = (
    where("o_totalprice > 1000"),
    join("customer", "inner", "left.o_custkey = right.c_custkey"),
    select("c_mktsegment AS segment", "CAST(o_totalprice AS DECIMAL(18,2)) AS amount", "o_custkey"),
    aggregate(
        ["segment"],
        "CAST(sum(amount) AS DOUBLE) AS revenue",
        "count(*) AS orders",
        "count(DISTINCT o_custkey) AS customers",
    ),
)
FLAGSHIP_CHECKS = [
    {"type": "not_null", "columns": ["segment", "revenue"]},
    {"type": "unique", "columns": ["segment"]},
    {"type": "row_count_min", "value": 1},
    {"type": "custom_sql", "query": "SELECT count(*) FROM output WHERE revenue <= 0"},
]


def flagship(spark, folder, **settings):
    """Orders by market segment, checked, published, read back."""
    sink = scratch(spark, "flagship")
    steps = [step(folder) if callable(step) else step for step in FLAGSHIP_STEPS]
    run_pipeline(spark, spec(
        folder, "orders", *steps, name="segment_revenue", sink_path=sink,
        checks=FLAGSHIP_CHECKS, **settings,
    ))
    return run_session(spark).read.parquet(sink)


def run_record(spark, folder):
    """The row a run leaves in the table of runs."""
    runs = scratch(spark, "runs")
    for name, table in (("copy_orders", "orders"), ("returned_lines", "lineitem")):
        steps = [where("l_returnflag = 'R'")] if table == "lineitem" else []
        run_pipeline(
            spark,
            spec(folder, table, *steps, name=name, sink_path=scratch(spark, name)),
            runs_path=runs,
        )
    return run_session(spark).read.parquet(runs).select(
        "pipeline_name", "status", "rows_extracted", "rows_written"
    )


def resume_after_stop(spark, folder):
    """A run that stops in its third step, then goes on from the second."""
    calls = {"stopped": True}

    def switched(table, params):
        if calls["stopped"]:
            raise RuntimeError("stopped")
        return table

    sink = scratch(spark, "resumed")
    made = spec(
        folder, "orders",
        where("o_orderstatus <> 'P'"),
        aggregate(["o_custkey"], "count(*) AS n", f"{money('o_totalprice')} AS total"),
        plugin("switched", chunk_rows=1000),
        name="customer_totals", sink_path=sink, checkpointing=True,
    )
    plugins = PluginRegistry({"switched": switched})
    try:
        run_pipeline(spark, made, plugins=plugins)
    except PipelineError:
        pass
    calls["stopped"] = False
    run_pipeline(spark, made, plugins=plugins)
    return run_session(spark).read.parquet(sink)


def clean_events(spark, folder):
    """Events made fit for a report: kinds and weekdays spelled alike, values in
    quarters, rows without a value or a user left out, and all of it checked."""
    sink = scratch(spark, "clean")
    run_pipeline(spark, {
        "name": "fit_for_report", "source_path": path_of(folder, "events"), "sink_path": sink,
        "transforms": [
            select("event_id", "user_id", "initcap(event_type) AS kind",
                   "date_format(ts, 'EEEE') AS weekday", "floor(value * 4) / 4 AS value"),
            where("value IS NOT NULL AND user_id IS NOT NULL"),
        ],
        "checks": [{"type": "not_null", "columns": ["kind", "value"]},
                   {"type": "unique", "columns": ["event_id"]}],
    })
    return run_session(spark).read.parquet(sink)


def date_parameters(spark, folder):
    return pipeline_frame(
        spark,
        spec(
            folder, "events",
            select("CASE WHEN ts < TIMESTAMP '{{today}} 00:00:00' THEN 'before {{today:%d.%m.%Y}}'"
                   " ELSE 'since {{today:%d.%m.%Y}}' END AS period", "value"),
            aggregate(["period"], "count(*) AS n", f"{money('value')} AS total"),
            timezone="Asia/Kolkata",
        ),
        now=datetime(2024, 1, 15, 20, 15, tzinfo=timezone.utc),
    )


def synth(spark, folder):
    session = session_with_tables(spark, folder, ["orders"])
    return readings(session.sql("SELECT o_orderkey AS reading_id FROM orders"))


def _draw(purpose: str) -> str:
    return f"CAST('0x' || substr(md5('{purpose}/' || CAST(reading_id AS VARCHAR)), 1, 7) AS BIGINT)"


_SEGMENTS = f"""
    SELECT c_mktsegment AS segment, {money('o_totalprice')} AS revenue, count(*) AS orders,
           count(DISTINCT o_custkey) AS customers
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_totalprice > 1000 GROUP BY 1
"""
_JOIN_AGGREGATES = ("count(*) AS n", "count(l_orderkey) AS lines", "count(o_orderkey) AS orders",
                    f"{money('l_extendedprice')} AS price")
_JOIN_GROUP = ["o_orderpriority", "l_returnflag"]
_JOIN_ON = "left.o_orderkey = right.l_orderkey"


def _joined(how: str, *before):
    return steps_query(
        "orders", *before, join("lineitem", how, _JOIN_ON), aggregate(_JOIN_GROUP, *_JOIN_AGGREGATES)
    )


def _join_oracle(how: str, left: str = "orders") -> str:
    return f"""
        SELECT o_orderpriority, l_returnflag, {', '.join(_JOIN_AGGREGATES)}
        FROM {left} {how} JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
    """


_EXPRESSIONS = (
    "event_id",
    "upper(trim(event_type)) AS kind",
    "md5(CAST(event_id AS STRING)) AS digest",
    "lpad(CAST(user_id AS STRING), 8, '0') AS user_code",
    "replace(event_type, 'c', 'k') || '-' || lower('ID') AS label",
    "CASE WHEN value > 100 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band",
    "CAST(CAST(value AS DECIMAL(18,2)) * 2 + 1 AS DOUBLE) AS twice",
    "CASE WHEN event_type LIKE '%c%' THEN 1 ELSE 0 END AS has_c",
)

QUERIES = {
    "select_exprs": (
        steps_query("events", select(*_EXPRESSIONS)),
        f"SELECT {', '.join(_EXPRESSIONS)} FROM events",
    ),
    "select_distinct": (
        steps_query("events", select("DISTINCT user_id", "event_type")),
        "SELECT DISTINCT user_id, event_type FROM events",
    ),
    "select_star_except": (
        steps_query("customer", select("* EXCEPT (c_name)", "c_acctbal < 0 AS in_debt")),
        "SELECT * EXCLUDE (c_name), c_acctbal < 0 AS in_debt FROM customer",
    ),
    "select_window": (
        steps_query(
            "orders",
            select("*", "row_number() OVER (PARTITION BY o_custkey "
                        "ORDER BY o_totalprice DESC, o_orderkey) AS position"),
            where("position <= 3"),
            select("o_custkey", "o_orderkey", "CAST(position AS BIGINT) AS position"),
        ),
        """SELECT o_custkey, o_orderkey, position FROM (
             SELECT *, row_number() OVER (PARTITION BY o_custkey
                                          ORDER BY o_totalprice DESC, o_orderkey) AS position
             FROM orders) WHERE position <= 3""",
    ),
    "filter_basic": (
        steps_query("lineitem", where("l_discount > 0.05 AND l_returnflag = 'R'")),
        "SELECT * FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'",
    ),
    "filter_nulls": (
        steps_query("events", where("NULLIF(event_type, 'error') NOT IN ('view')"),
                    select("event_id", "event_type")),
        "SELECT event_id, event_type FROM events WHERE NULLIF(event_type, 'error') NOT IN ('view')",
    ),
    "filter_subquery": (
        steps_query(
            "orders",
            where("o_custkey IN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 9000)"),
            datasets=["customer"],
        ),
        "SELECT * FROM orders WHERE o_custkey IN "
        "(SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    ),
    "aggregate_sum_count": (
        steps_query("lineitem", aggregate(
            ["l_returnflag", "l_linestatus"], "sum(l_quantity) AS qty", "count(*) AS n",
            f"{money('l_extendedprice')} AS price", "min(l_shipdate) AS first_ship",
            "max(l_shipdate) AS last_ship")),
        f"""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n,
                   {money('l_extendedprice')} AS price, min(l_shipdate) AS first_ship,
                   max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2""",
    ),
    "aggregate_null_group": (
        steps_query("events", aggregate(
            ["NULLIF(event_type, 'error') AS kind"], "count(*) AS n", f"{money('value')} AS total")),
        f"SELECT NULLIF(event_type, 'error') AS kind, count(*) AS n, {money('value')} AS total "
        "FROM events GROUP BY 1",
    ),
    "aggregate_global": (
        steps_query("lineitem", aggregate(
            [], "count(*) AS n", "count(DISTINCT l_orderkey) AS orders",
            f"{money('l_extendedprice')} AS price")),
        f"SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, "
        f"{money('l_extendedprice')} AS price FROM lineitem",
    ),
    "aggregate_day": (
        steps_query("events", aggregate(
            ["CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS day"], "count(*) AS n",
            "count(DISTINCT user_id) AS users")),
        "SELECT date_trunc('day', ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users "
        "FROM events GROUP BY 1",
    ),
    "join_inner": (_joined("inner"), _join_oracle("INNER")),
    "join_left": (_joined("left"), _join_oracle("LEFT")),
    "join_right": (
        _joined("right", where("o_orderstatus = 'F'")),
        _join_oracle("RIGHT", "(SELECT * FROM orders WHERE o_orderstatus = 'F')"),
    ),
    "join_full": (
        _joined("full", where("o_orderstatus = 'F'")),
        _join_oracle("FULL", "(SELECT * FROM orders WHERE o_orderstatus = 'F')"),
    ),
    "join_theta": (
        join_theta,
        """SELECT lo, count(*) AS n, sum(l_quantity) AS qty
           FROM lineitem JOIN (
             SELECT month AS lo, month + INTERVAL 1 MONTH AS hi
             FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS month FROM orders)
           ) ON l_shipdate >= lo AND l_shipdate < hi GROUP BY 1""",
    ),
    "join_clash": (
        steps_query("orders", join("orders", "inner", "left.o_orderkey = right.o_orderkey")),
        """SELECT l.*, r.o_orderkey AS o_orderkey_1, r.o_custkey AS o_custkey_1,
                  r.o_orderstatus AS o_orderstatus_1, r.o_totalprice AS o_totalprice_1,
                  r.o_orderdate AS o_orderdate_1, r.o_orderpriority AS o_orderpriority_1
           FROM orders l JOIN orders r ON l.o_orderkey = r.o_orderkey""",
    ),
    "join_theta_full": (
        join_theta_full,
        """SELECT o_orderkey, c_custkey FROM orders FULL JOIN customer
           ON o_totalprice >= c_acctbal * 40 AND o_totalprice <= c_acctbal * 40 + 5""",
    ),
    "join_theta_one_bound": (
        join_theta_one_bound,
        " UNION ALL ".join(
            f"""SELECT '{how}' AS how, s_suppkey, count(c_custkey) AS n, count(*) AS n_rows,
                  CAST(round(sum(c_acctbal) * 100) AS BIGINT) AS cents
                FROM customer {how} JOIN supplier ON c_acctbal + 9000 <= s_acctbal GROUP BY s_suppkey"""
            for how in ("INNER", "LEFT", "RIGHT", "FULL")).replace("'INNER'", "'inner'").replace(
            "'LEFT'", "'left'").replace("'RIGHT'", "'right'").replace("'FULL'", "'full'"),
    ),
    "join_full_more": (
        join_full_more,
        """SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier
           ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal + 9000""",
    ),
    "join_range": (
        join_range,
        """SELECT event_id, e.user_id, e.user_id AS user_id_1, date_trunc('day', ts) AS lo,
                  count(*) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS n
           FROM events e""",
    ),
    "join_text_right": (
        join_text_right,
        f"""SELECT c_mktsegment, count(*) AS n, {money('o_totalprice')} AS total
            FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    ),
    "plugin_rowwise": (
        steps_query("lineitem", plugin("discounted", chunk_rows=50_000), plugins=PLUGINS),
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS disc_price "
        "FROM lineitem",
    ),
    "plugin_chunked": (
        steps_query(
            "events",
            plugin("add_constant", chunk_rows=700, params={"add": 100, "at_most": 700}),
            plugins=PLUGINS,
        ),
        "SELECT event_id, user_id + 100 AS shifted FROM events",
    ),
    "plugin_slices": (
        plugin_slices,
        "SELECT min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS slice_rows "
        "FROM events GROUP BY event_id // 3000",
    ),
    "plugin_grouped": (
        steps_query("lineitem", plugin("share_of_total", group_by=["l_returnflag"]), plugins=PLUGINS),
        """SELECT l_orderkey, l_linenumber, l_returnflag,
                  l_quantity / sum(l_quantity) OVER (PARTITION BY l_returnflag) AS share FROM lineitem""",
    ),
    "plugin_whole": (
        steps_query("lineitem", plugin("share_of_total"), plugins=PLUGINS),
        """SELECT l_orderkey, l_linenumber, l_returnflag,
                  l_quantity / sum(l_quantity) OVER () AS share FROM lineitem""",
    ),
    "flagship_run": (flagship, _SEGMENTS),
    "run_record": (
        run_record,
        """SELECT 'copy_orders' AS pipeline_name, 'success' AS status, count(*) AS rows_extracted,
                  count(*) AS rows_written FROM orders
           UNION ALL
           SELECT 'returned_lines', 'success', count(*), count(*) FILTER (l_returnflag = 'R')
           FROM lineitem""",
    ),
    "resume_after_stop": (
        resume_after_stop,
        f"""SELECT o_custkey, count(*) AS n, {money('o_totalprice')} AS total
            FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
    ),
    "date_parameters": (
        date_parameters,
        f"""SELECT CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'before 16.01.2024'
                        ELSE 'since 16.01.2024' END AS period,
                   count(*) AS n, {money('value')} AS total FROM events GROUP BY 1""",
    ),
    "clean_events": (
        clean_events,
        """SELECT event_id, user_id, upper(event_type[1]) || lower(event_type[2:]) AS kind,
                  dayname(ts) AS weekday, floor(value * 4) / 4 AS value
           FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL""",
    ),
    "synth_events": (
        synth,
        f"""WITH ids AS (SELECT o_orderkey AS reading_id FROM orders)
            SELECT reading_id, {_draw('place')} % 500 AS station,
                   TIMESTAMP '2030-03-01 00:00:00'
                     + to_seconds(reading_id * 90 + {_draw('late')} % 90) AS taken_at,
                   CASE WHEN {_draw('gap')} % 16 > 0
                        THEN ({_draw('a')} % 400 + {_draw('b')} % 400) / 8.0::DOUBLE END AS level_cm,
                   CASE WHEN {_draw('power')} % 100 < 3 THEN 'battery low' ELSE 'ok' END AS state
            FROM ids""",
    ),
}
