"""What the operators share: sessions, sizes, ranges of ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import run_session

# Rows of a batch may be texts of a hundred kilobytes; batches stay small.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
MAX_RANGES = 4096


def session(spark: SparkSession) -> SparkSession:
    return run_session(spark, BATCH_ROWS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, in a session with small Arrow batches."""
    return session(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files (or other leaves) under a plan, from the planner's own
    statistics; rows times 4 KB where it has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < 1 << 56 else df.count() * 4096


def pieces(df: DataFrame, bytes_each: int) -> int:
    """How many parts of about this size the input makes: work is cut by size, so a
    part stays as large as it is when the input grows."""
    return max(1, -(-input_bytes(df) // bytes_each))


def range_cuts(df: DataFrame, column: str, parts: int) -> list[int]:
    """Rising values of an integer column that cut its rows into about equal parts, at
    most MAX_RANGES of them; a value that many rows have occurs more than once."""
    parts = min(parts, MAX_RANGES)
    if parts < 2:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    row = df.select(F.percentile_approx(column, shares, F.lit(10 * MAX_RANGES)).alias("b")).first()
    return sorted(int(b) for b in row["b"] or [] if b is not None)


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """The distinct values of :func:`range_cuts`."""
    return sorted(set(range_cuts(df, column, parts)))


class Ranges:
    """Which range of rising bounds a value lies in; every range is cut further into
    ``each`` equal steps, so that more parts than bounds can be had. Order is kept: a
    smaller value never lies in a later part."""

    def __init__(self, bounds: list[int], each: int = 1):
        self.bounds, self.each = np.array(bounds, np.int64), max(1, each)

    def __len__(self) -> int:
        return (len(self.bounds) + 1) * self.each

    def of(self, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, values, side="right")
        if self.each == 1 or not len(self.bounds):
            return at * self.each
        edges = np.concatenate([self.bounds[:1], self.bounds, self.bounds[-1:]]).astype(float)
        low, high = edges[at], edges[at + 1]
        share = np.clip((values - low) / np.maximum(high - low, 1), 0, 0.999999)
        return at * self.each + (share * self.each).astype(np.int64)
