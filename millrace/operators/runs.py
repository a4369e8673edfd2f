"""Reports over a table of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Statuses a count always lists.
RUN_STATUSES = ("success", "failed", "started")
RECENT_LIMIT = 15


def status_counts(runs: DataFrame, statuses=RUN_STATUSES) -> DataFrame:
    """``status, runs`` per status, zeros included, and a ``total_runs`` row."""
    listed = runs.sparkSession.createDataFrame(
        [(s, 0) for s in statuses], "status string, runs bigint"
    )
    counts = runs.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))
    total = F.grouping("status") == 1
    return (
        counts.unionByName(listed)
        .rollup("status")
        .agg(F.sum("runs").alias("runs"), total.alias("is_total"))
        .select(
            F.when(F.col("is_total"), "total_runs").otherwise(F.col("status")).alias("status"),
            F.coalesce("runs", F.lit(0)).alias("runs"),
        )
    )


def recent_runs(runs: DataFrame, limit: int = RECENT_LIMIT, *tie_breakers: str) -> DataFrame:
    """The newest runs with their duration in seconds, to one decimal."""
    return runs.orderBy(F.desc("started_at"), *tie_breakers).limit(limit).withColumn(
        "duration", duration_seconds("started_at", "finished_at")
    )


def duration_seconds(start: str, end: str):
    micros = F.timestamp_diff("MICROSECOND", F.col(start), F.col(end))
    return F.round(micros / 1e6, 1)


def history(runs: DataFrame, pipeline: str, limit: int, *tie_breakers: str) -> DataFrame:
    """The newest runs of one pipeline."""
    return (
        runs.where(F.col("pipeline_name") == pipeline)
        .orderBy(F.desc("started_at"), *tie_breakers)
        .limit(limit)
    )


def history_of_all(runs: DataFrame, limit: int, *tie_breakers: str) -> DataFrame:
    """The newest runs of every pipeline, numbered. The rank limit is applied before
    the shuffle too, so a pipeline with very many runs sends few of them."""
    newest = Window.partitionBy("pipeline_name").orderBy(F.desc("started_at"), *tie_breakers)
    return runs.withColumn("position", F.row_number().over(newest)).where(
        F.col("position") <= limit
    )


def last_success(runs: DataFrame) -> DataFrame:
    """When each pipeline last finished well."""
    return (
        runs.where(F.col("status") == "success")
        .groupBy("pipeline_name")
        .agg(F.max("finished_at").alias("finished_at"))
    )
