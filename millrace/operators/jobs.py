"""State changes of a job table, each one projection, filter or anti join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import messages

# States and defaults.
ACTIVE_STATUSES = ("queued", "running")
STALE_SECONDS = 60
RETRY_DELAY_SECONDS = 60
RUNNABLE_LIMIT = 5


def is_stale(now: Column, stale_seconds: int = STALE_SECONDS) -> Column:
    """Running, and neither a heartbeat nor (without one) a start since the cutoff."""
    seen = F.coalesce(F.col("heartbeat_at"), F.col("started_at"))
    return (F.col("status") == "running") & F.coalesce(
        seen < _shift(now, -stale_seconds), F.lit(False)
    )


def recover_stale(jobs: DataFrame, now: Column, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """The job table with stale jobs queued again or failed; adds ``recovered``."""
    stale = is_stale(now, stale_seconds)
    retry = stale & _attempts_left()
    dead = stale & ~_attempts_left()
    return _change(
        jobs.withColumn("recovered", stale),
        {
            "trigger": [(retry, F.lit("retry"))],
            "run_after": [(retry, now)],
            "heartbeat_at": [(retry, F.lit(None))],
            "worker_pid": [(retry, F.lit(None))],
            "finished_at": [(dead, now)],
            "error_message": [(retry, F.lit(messages.REQUEUED)), (dead, F.lit(messages.EXHAUSTED))],
            "status": [(retry, F.lit("queued")), (dead, F.lit("failed"))],
        },
    )


def finish_jobs(
    jobs: DataFrame, now: Column, retry_delay_seconds: int = RETRY_DELAY_SECONDS
) -> DataFrame:
    """Jobs with an ``outcome`` (and ``outcome_message``): a failure with attempts
    left is queued again after the delay, anything else ends the job."""
    done = F.col("outcome").isNotNull()
    retry = done & (F.col("outcome") == "failed") & _attempts_left()
    ended = done & ~retry
    return _change(
        jobs,
        {
            "trigger": [(retry, F.lit("retry"))],
            "run_after": [(retry, _shift(now, retry_delay_seconds))],
            "heartbeat_at": [(retry, F.lit(None))],
            "worker_pid": [(retry, F.lit(None))],
            "finished_at": [(ended, now)],
            "error_message": [(done, F.col("outcome_message"))],
            "status": [(retry, F.lit("queued")), (ended, F.col("outcome"))],
        },
    )


def runnable_jobs(
    jobs: DataFrame, now: Column, limit: int = RUNNABLE_LIMIT, *tie_breakers: str
) -> DataFrame:
    """Queued jobs that are due, oldest first."""
    return (
        jobs.where((F.col("status") == "queued") & (F.col("run_after") <= now))
        .orderBy("enqueued_at", *tie_breakers)
        .limit(limit)
    )


def recent_jobs(jobs: DataFrame, limit: int = 50, *tie_breakers: str) -> DataFrame:
    return jobs.orderBy(F.desc("enqueued_at"), *tie_breakers).limit(limit)


def active_pipelines(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE_STATUSES)).select("pipeline").distinct()


def new_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests whose pipeline has no queued or running job. Active pipelines are
    made distinct first, so a hot one meets the requests as a single row."""
    return requests.join(active_pipelines(jobs), "pipeline", "left_anti")


def active_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    return requests.join(active_pipelines(jobs), "pipeline", "left_semi")


def _attempts_left() -> Column:
    return F.col("attempts") < F.col("max_attempts")


def _shift(moment: Column, seconds: int) -> Column:
    return moment + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def _change(df: DataFrame, changes: dict[str, list[tuple[Column, Column]]]) -> DataFrame:
    """All columns in one projection; a column the table lacks is left out."""
    columns = []
    for name in df.columns:
        value = F.col(name)
        for condition, new in reversed(changes.get(name, [])):
            value = F.when(condition, new.cast(df.schema[name].dataType)).otherwise(value)
        columns.append(value.alias(name))
    return df.select(*columns)
