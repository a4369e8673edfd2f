"""Data-quality checks, failures as rows.

``not_null``, ``row_count_min`` and ``accepted_values`` share one aggregation that
shuffles nothing but partial counts. Each ``unique`` column has its own two-step
count, which reads that column only and shuffles its distinct values with their
counts; several exact distinct counts in one aggregation would multiply the rows.

Rules, pinned by tests: ``unique`` looks at each column alone and counts every
NULL as a duplicate; ``accepted_values`` lets NULL pass; all failures are listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import messages

def check_report(df: DataFrame, checks: list[dict]) -> DataFrame:
    """One row per check and column of ``not_null``, ``unique``, ``row_count_min``
    and ``accepted_values``; still lazy, still a DataFrame."""
    plain, parts, position = [], [], 0
    for check in checks:
        for column in _columns_of(check):
            if check["type"] == "unique":
                parts.append(_unique_line(df, column, position))
            else:
                plain.append(_plain_line(check, column, position))
            position += 1
    if plain:
        parts.insert(0, df.agg(F.array(*plain).alias("lines")).select(F.inline("lines")))
    if not parts:
        return df.sparkSession.createDataFrame([], _REPORT_DDL)
    return reduce(DataFrame.unionByName, parts)


_REPORT_DDL = (
    "position int, check string, column string, observed bigint, expected bigint, "
    "null_rows bigint, passed boolean"
)


def _columns_of(check: dict) -> list[str]:
    if check["type"] in ("not_null", "unique"):
        return check["columns"]
    return {"row_count_min": [""], "accepted_values": [check.get("column")]}.get(check["type"], [])


def _plain_line(check: dict, column: str, position: int) -> Column:
    kind = check["type"]
    if kind == "row_count_min":
        observed, value = F.count(F.lit(1)), check["value"]
        return _line(position, kind, "", observed, value, F.lit(0), observed >= value)
    nulls = F.count_if(F.expr(column).isNull())
    observed = nulls
    if kind == "accepted_values":
        allowed = [str(value) for value in check["values"]]
        observed = F.count_if(~F.expr(column).isin(allowed))
    return _line(position, kind, column, observed, 0, nulls, observed == 0)


def _unique_line(df: DataFrame, column: str, position: int) -> DataFrame:
    counts = df.groupBy(F.expr(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    observed = rows - F.count("value")
    line = _line(position, "unique", column, observed, 0, nulls, observed == 0)
    return counts.agg(line.alias("line")).select("line.*")


def _line(position, kind, column, observed, expected, nulls, passed) -> Column:
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(kind).alias("check"),
        F.lit(column).alias("column"),
        observed.cast("bigint").alias("observed"),
        F.lit(expected).cast("bigint").alias("expected"),
        nulls.cast("bigint").alias("null_rows"),
        passed.alias("passed"),
    )


def custom_sql_report(session, checks: list[dict]) -> list[tuple]:
    """``(query, observed, expected, passed)`` of each custom query; the data under
    test is the view ``output`` of the given session."""
    results = []
    for check in checks:
        if check["type"] == "custom_sql":
            observed = session.sql(check["query"]).first()[0]
            expected = check.get("must_be", 0)
            results.append((check["query"], observed, expected, observed == expected))
    return results


def run_checks(df: DataFrame, checks: list[dict], session) -> list[str]:
    """Failure messages in the order the checks were given; none means all passed.

    ``df`` should be written data: the checks read only the columns they name.
    """
    report = check_report(df, checks)
    # One row per check and column of the spec.
    rows = {row["position"]: row for row in report.collect()}
    custom = iter(_custom_results(df, checks, session))
    failures, position = [], 0
    for check in checks:
        if check["type"] == "custom_sql":
            _, observed, expected, passed = next(custom)
            if not passed:
                failures.append(
                    messages.CUSTOM_SQL.format(observed=observed, expected=expected)
                )
            continue
        for _ in _columns_of(check):
            row = rows[position]
            position += 1
            if not row["passed"]:
                failures.append(_message(row))
    return failures


def _custom_results(df, checks, session):
    if not any(check["type"] == "custom_sql" for check in checks):
        return []
    df.createOrReplaceTempView("output")
    return custom_sql_report(session, checks)


def _message(row) -> str:
    return getattr(messages, row["check"].upper()).format(**row.asDict())
