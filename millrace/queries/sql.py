"""Ad-hoc SQL: paging, counting, files in SQL, and the promised SQL surface.

Windows and as-of lookups are written in two levels. A plain window sorts all rows
of a key in one task; here a coarse slice of the order column joins the key, rows
are ordered inside a slice, and only one summary row per slice is ordered per key.
"""

from __future__ import annotations

from millrace.plans.adhoc import page_frame, run_sql, total_rows
from millrace.plans.paging import page_at
from millrace.queries.common import path_of, session_with_tables, sql_query


def page_sql(spark, folder):
    df = run_sql(spark, "SELECT * FROM orders;", views={"orders": path_of(folder, "orders")})
    return page_frame(df, page=2, page_size=50, order_by="o_orderkey")


def page_deep(spark, folder):
    """A page in the middle of all line items, found by counts per range of the sort key."""
    items = session_with_tables(spark, folder, ["lineitem"]).table("lineitem").select(
        "l_shipdate", "l_extendedprice", "l_orderkey")
    return page_at(items, ["l_shipdate", "l_extendedprice", "l_orderkey"], items.count() // 2, 200,
                   descending=("l_shipdate",), window_rows=5_000)


def count_rows(spark, folder):
    text = "SELECT o_custkey FROM orders GROUP BY o_custkey -- one row per customer\n;"
    return total_rows(run_sql(spark, text, views={"orders": path_of(folder, "orders")}))


def file_functions(spark, folder):
    return run_sql(spark, f"""
        SELECT c_mktsegment, count(*) AS n, 'read_csv(''x'')' AS text
        FROM read_parquet('{path_of(folder, "orders")}')
        JOIN read_parquet('{path_of(folder, "customer")}') ON o_custkey = c_custkey
        GROUP BY c_mktsegment
    """)


def direct_files(spark, folder):
    """Spark's own spelling of a file in SQL."""
    session = session_with_tables(spark, folder, [])
    return session.sql(
        f"SELECT p_brand, count(*) AS n FROM parquet.`{path_of(folder, 'part')}` GROUP BY p_brand")


# Rank and previous price of each customer's orders. Slices of 100 in price.
_WINDOW = """
WITH sliced AS (
  SELECT o_custkey, o_orderkey, o_totalprice, CAST(floor(o_totalprice / 100) AS BIGINT) AS slice
  FROM orders
), local AS (
  SELECT *,
    row_number() OVER w AS place,
    lag(o_totalprice) OVER w AS prev_in_slice
  FROM sliced
  WINDOW w AS (PARTITION BY o_custkey, slice ORDER BY o_totalprice DESC, o_orderkey)
), slices AS (
  SELECT o_custkey, slice, count(*) AS n, min(o_totalprice) AS last_price
  FROM sliced GROUP BY o_custkey, slice
), offsets AS (
  SELECT o_custkey, slice,
    coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY slice DESC
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    lag(last_price) OVER (PARTITION BY o_custkey ORDER BY slice DESC) AS prev_slice_price
  FROM slices
)
SELECT l.o_custkey, l.o_orderkey, CAST(f.before + l.place AS BIGINT) AS position,
       coalesce(l.prev_in_slice, f.prev_slice_price) AS previous_price
FROM local l JOIN offsets f ON l.o_custkey = f.o_custkey AND l.slice = f.slice
"""

# Last purchase of the same user at or before each event. Slices of one minute.
_ASOF = """
WITH sliced AS (
  SELECT event_id, user_id, ts, event_type, value, date_trunc('minute', ts) AS slice FROM events
), local AS (
  SELECT event_id, user_id, slice,
    max(CASE WHEN event_type = 'purchase' THEN struct(ts, event_id, value) END)
      OVER (PARTITION BY user_id, slice ORDER BY ts
            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS found
  FROM sliced
), slices AS (
  SELECT user_id, slice,
    max(CASE WHEN event_type = 'purchase' THEN struct(ts, event_id, value) END) AS newest
  FROM sliced GROUP BY user_id, slice
), carried AS (
  SELECT user_id, slice,
    max(newest) OVER (PARTITION BY user_id ORDER BY slice
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM slices
)
SELECT l.event_id, l.user_id, coalesce(l.found, c.earlier).event_id AS purchase_id,
       coalesce(l.found, c.earlier).value AS purchase_value
FROM local l JOIN carried c ON l.user_id = c.user_id AND l.slice = c.slice
"""

_CTE = """
WITH spend AS (
  SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM orders GROUP BY o_custkey
), ranked AS (
  SELECT c_mktsegment, max(total) AS best, count(*) AS customers
  FROM spend JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
)
SELECT * FROM ranked
"""

_PIVOT = """
SELECT * FROM (SELECT user_id, event_type FROM events)
PIVOT (count(*) FOR event_type IN ('view', 'click', 'purchase', 'signup', 'error'))
"""

_UNNEST = """
SELECT word, count(*) AS n, min(doc_id) AS first_doc
FROM (SELECT doc_id, explode(split(text, ' ', -1)) AS word FROM documents)
GROUP BY word
"""

_JSON = """
SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n
FROM events GROUP BY 1
"""

_SET_OPS = """
(SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'
 INTERSECT
 SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
EXCEPT
SELECT c_custkey FROM customer WHERE c_acctbal < 0
"""

_SET_OPS_ALL = """
SELECT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'R'
EXCEPT ALL
SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'
"""

_ROLLUP = """
SELECT o_orderstatus, o_orderpriority, count(*) AS n,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY {kind}
"""

_SEMI_ANTI = """
SELECT c_custkey, 'large order' AS kind FROM customer
LEFT SEMI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000)
  ON c_custkey = o_custkey
UNION ALL
SELECT c_custkey, 'no urgent order' AS kind FROM customer
LEFT ANTI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
  ON c_custkey = o_custkey
"""

_SORTED = """
SELECT NULLIF(event_type, 'error') AS kind, CAST(ts AS DATE) = DATE '2024-01-15' AS mid, count(*) AS n
FROM events GROUP BY ALL ORDER BY kind NULLS LAST, mid
"""

_DATES = """
SELECT date_format(o_orderdate, 'yyyy-MM') AS month, CAST(weekday(o_orderdate) AS BIGINT) AS day,
       CAST(min(o_orderdate) + INTERVAL 7 DAY AS TIMESTAMP_NTZ) AS week_later,
       CAST(sum(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE))) AS BIGINT) AS age_days
FROM orders GROUP BY 1, 2
"""

_MATH = """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_partkey div 7 AS BIGINT) AS sevens,
       l_partkey % 7 AS rest, round(l_quantity / 3, 2) AS thirds,
       try_divide(l_extendedprice, l_partkey % 2) AS maybe, try_cast(l_returnflag AS INT) AS no_int
FROM lineitem
"""

_AGGREGATES = """
SELECT l_returnflag, avg(l_quantity) AS avg_qty, min(l_shipdate) AS first_ship,
       max(l_shipdate) AS last_ship, CAST(count_if(l_tax > 0.04) AS BIGINT) AS taxed,
       bool_or(l_discount > 0.09) AS any_deep, count(DISTINCT l_suppkey) AS suppliers,
       CAST(sum(l_linenumber) AS BIGINT) AS line_sum
FROM lineitem GROUP BY ALL HAVING count(*) > 1
"""

QUERIES = {
    "page_deep": (
        page_deep,
        """SELECT l_shipdate, l_extendedprice, l_orderkey FROM lineitem
           ORDER BY l_shipdate DESC, l_extendedprice, l_orderkey
           LIMIT 200 OFFSET (SELECT count(*) // 2 FROM lineitem)""",
    ),
    "page_sql": (page_sql, "SELECT * FROM orders ORDER BY o_orderkey LIMIT 51 OFFSET 100"),
    "count_rows": (count_rows, "SELECT count(DISTINCT o_custkey) AS total_rows FROM orders"),
    "file_functions": (
        file_functions,
        "SELECT c_mktsegment, count(*) AS n, 'read_csv(''x'')' AS text "
        "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    ),
    "direct_files": (direct_files, "SELECT p_brand, count(*) AS n FROM part GROUP BY 1"),
    "sql_window": (
        sql_query(_WINDOW, ["orders"]),
        """SELECT o_custkey, o_orderkey, row_number() OVER w AS position,
                  lag(o_totalprice) OVER w AS previous_price
           FROM orders
           WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""",
    ),
    "sql_asof": (
        sql_query(_ASOF, ["events"]),
        """SELECT e.event_id, e.user_id, p.event_id AS purchase_id, p.value AS purchase_value
           FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
           ON e.user_id = p.user_id AND e.ts >= p.ts""",
    ),
    "sql_aggregates": (sql_query(_AGGREGATES, ["lineitem"]), _AGGREGATES),
    "sql_cte": (sql_query(_CTE, ["orders", "customer"]), _CTE),
    "sql_pivot": (
        sql_query(_PIVOT, ["events"]),
        """SELECT user_id, count(*) FILTER (event_type = 'view') AS view,
                  count(*) FILTER (event_type = 'click') AS click,
                  count(*) FILTER (event_type = 'purchase') AS purchase,
                  count(*) FILTER (event_type = 'signup') AS signup,
                  count(*) FILTER (event_type = 'error') AS error
           FROM events GROUP BY 1""",
    ),
    "sql_unnest": (
        sql_query(_UNNEST, ["documents"]),
        """SELECT word, count(*) AS n, min(doc_id) AS first_doc
           FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1""",
    ),
    "sql_json": (
        sql_query(_JSON, ["events"]),
        "SELECT CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k, count(*) AS n "
        "FROM events GROUP BY 1",
    ),
    "sql_set_ops": (sql_query(_SET_OPS, ["orders", "customer"]), _SET_OPS),
    "sql_set_ops_all": (sql_query(_SET_OPS_ALL, ["lineitem"]), _SET_OPS_ALL),
    "sql_rollup": (
        sql_query(_ROLLUP.format(kind="ROLLUP (o_orderstatus, o_orderpriority)"), ["orders"]),
        _ROLLUP.format(kind="ROLLUP (o_orderstatus, o_orderpriority)"),
    ),
    "sql_cube": (
        sql_query(_ROLLUP.format(kind="CUBE (o_orderstatus, o_orderpriority)"), ["orders"]),
        _ROLLUP.format(kind="CUBE (o_orderstatus, o_orderpriority)"),
    ),
    "sql_grouping_sets": (
        sql_query(_ROLLUP.format(
            kind="GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"), ["orders"]),
        _ROLLUP.format(kind="GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    ),
    "sql_semi_anti": (
        sql_query(_SEMI_ANTI, ["orders", "customer"]),
        """SELECT c_custkey, 'large order' AS kind FROM customer
           WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
           UNION ALL
           SELECT c_custkey, 'no urgent order' FROM customer
           WHERE c_custkey NOT IN (SELECT o_custkey FROM orders
                                   WHERE o_orderpriority = '1-URGENT')""",
    ),
    "sql_sort": (sql_query(_SORTED, ["events"]), _SORTED),
    "sql_dates": (
        sql_query(_DATES, ["orders"]),
        """SELECT strftime(o_orderdate, '%Y-%m') AS month,
                  CAST(isodow(o_orderdate) - 1 AS BIGINT) AS day,
                  min(o_orderdate) + INTERVAL 7 DAY AS week_later,
                  CAST(sum(DATE '2002-01-01' - CAST(o_orderdate AS DATE)) AS BIGINT) AS age_days
           FROM orders GROUP BY 1, 2""",
    ),
    "sql_math": (
        sql_query(_MATH, ["lineitem"]),
        """SELECT l_orderkey, l_partkey, l_suppkey, l_partkey // 7 AS sevens, l_partkey % 7 AS rest,
                  round(l_quantity / 3, 2) AS thirds,
                  CASE WHEN l_partkey % 2 <> 0 THEN l_extendedprice / (l_partkey % 2) END AS maybe,
                  try_cast(l_returnflag AS INT) AS no_int FROM lineitem""",
    ),
}
