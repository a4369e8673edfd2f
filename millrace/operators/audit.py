"""Search, facets and retention of an access-log table."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace import storage
from millrace.operators.sinks import staged_overwrite
from millrace.plans.paging import page_at

# Fixed value: rows of a search page.
DEFAULT_LIMIT = 100


def audit_search(
    log: DataFrame,
    *,
    username: str | None = None,
    action: str | None = None,
    target_type: str | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    tie_breakers: tuple[str, ...] = ("id",),
) -> DataFrame:
    """Entries that match every given filter, newest first: one page of ``limit`` rows.

    A late page reads only its range of the order (:func:`millrace.plans.paging.page_at`).
    """
    wanted = {"username": username, "action": action, "target_type": target_type}
    for column, value in wanted.items():
        if value:
            log = log.where(F.col(column) == value)
    return page_at(log, ["timestamp", *tie_breakers], max(0, offset), max(1, limit),
                   descending=("timestamp",))


def facets(log: DataFrame, columns: tuple[str, ...] = ("action", "target_type")) -> DataFrame:
    """Distinct non-empty values of each column as ``facet, value``; one scan."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return (
        log.select(F.inline(pairs))
        .where(F.col("value").isNotNull() & (F.col("value") != ""))
        .distinct()
        .orderBy("facet", "value")
    )


def within_retention(
    log: DataFrame, days: int | None, now: datetime, column: str = "timestamp"
) -> DataFrame:
    """Rows to keep; zero or fewer days keep everything."""
    if not days or days <= 0:
        return log
    cutoff = _cutoff(log, days, now, column)
    return log.where(F.col(column).isNull() | (F.col(column) >= cutoff))


def prune(
    spark: SparkSession,
    path: str,
    days: int | None,
    *,
    now: datetime | None = None,
    column: str = "timestamp",
    partition_by: str | None = None,
) -> int:
    """Drop rows older than ``days`` from a table folder; returns how many.

    Only partition folders with expired rows are touched: one whose rows have all
    expired is removed, another is written again in its place. Without expired rows
    nothing is written. ``partition_by`` names a date column that is the outermost
    partition: then whole days go by their folders, and a day is kept until all of it
    has expired.
    """
    if not days or days <= 0:
        return 0
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    table = spark.read.parquet(storage.storage_uri(spark, path))
    if partition_by:
        return _drop_days(spark, table, path, partition_by, now - timedelta(days=days))
    root = _without_scheme(storage.absolute(spark, path)).rstrip("/")
    place = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]+$", 1)
    # One row for each partition folder; the driver lists as many to scan the table.
    folders = (
        table.groupBy(place.alias("folder"))
        .agg(F.count_if(F.col(column) < _cutoff(table, days, now, column)).alias("expired"),
             F.count(F.lit(1)).alias("rows"))
        .where("expired > 0").collect()
    )
    for row in folders:
        below = unquote(_without_scheme(row["folder"]))[len(root):].strip("/")
        target = f"{path.rstrip('/')}/{below}" if below else path
        if below and row["expired"] == row["rows"]:
            storage.delete(spark, target)
            continue
        keys = {part.partition("=")[0] for part in below.split("/") if part}
        stored = StructType([field for field in table.schema if field.name not in keys])
        rows = spark.read.schema(stored).parquet(storage.storage_uri(spark, target))
        staged_overwrite(within_retention(rows, days, now, column), target)
    return sum(row["expired"] for row in folders)


def _cutoff(log: DataFrame, days: int, now: datetime, column: str):
    # As text: a datetime literal would pass through the driver's own zone.
    return F.lit(str(now - timedelta(days=days))).cast(log.schema[column].dataType)


def _without_scheme(uri: str) -> str:
    return re.sub("^[A-Za-z0-9]+:/*", "/", uri)


def _drop_days(spark, table, path, partition_by, cutoff) -> int:
    """Remove the folders of days before the cutoff's; names are taken from the listing."""
    old = []
    for name, _ in storage.children(spark, path):
        key, _, value = name.partition("=")
        if key == partition_by and re.fullmatch(r"\d{4}-\d\d-\d\d", unquote(value)):
            if unquote(value) < str(cutoff.date()):
                old.append(name)
    if not old:
        return 0
    day = F.col(partition_by).cast("date")
    dropped = table.where(day < F.lit(str(cutoff.date())).cast("date")).count()
    for name in old:
        storage.delete(spark, f"{path.rstrip('/')}/{name}")
    return dropped
