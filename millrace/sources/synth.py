"""Synthetic sensor readings from a column of ids, reproducible from the id alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

START = "2030-03-01 00:00:00"
SECONDS_APART = 90


def reading_ids(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(rows).withColumnRenamed("id", "reading_id")


def readings(ids: DataFrame, stations: int = 500) -> DataFrame:
    """One water level for each ``reading_id``: a projection, nothing shuffled.

    Whatever one would draw at random comes from a digest of the id, so a lost task
    makes the same rows again. Levels are the sum of two draws and so peak in the
    middle; one reading in sixteen has none.
    """
    return ids.selectExpr(
        "CAST(reading_id AS BIGINT) AS reading_id",
        f"{_draw('place')} % {stations} AS station",
        f"TIMESTAMP_NTZ '{START}' + (reading_id * {SECONDS_APART} + {_draw('late')} % {SECONDS_APART})"
        " * INTERVAL '1' SECOND AS taken_at",
        f"CASE WHEN {_draw('gap')} % 16 > 0 THEN ({_draw('a')} % 400 + {_draw('b')} % 400) / 8.0D END"
        " AS level_cm",
        f"CASE WHEN {_draw('power')} % 100 < 3 THEN 'battery low' ELSE 'ok' END AS state",
    )


def _draw(purpose: str) -> str:
    digest = f"md5(concat('{purpose}/', CAST(reading_id AS STRING)))"
    return f"CAST(conv(substr({digest}, 1, 7), 16, 10) AS BIGINT)"
