"""Session settings and the shared work folder of a run."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_CUTS: ContextVar[list[str] | None] = ContextVar("cuts", default=None)

# Set on every run session. TIMESTAMP means one without a zone, in casts and in
# inferred CSV and JSON columns, as in the files the pipelines read. The forced skew split matters for a join whose output
# is grouped on the join key: without it the adaptive planner keeps the key's
# partitioning and leaves a hot key in one task.
_RUN_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.shuffle.orderIndependentChecksum.enabled": "true",
    "spark.sql.shuffle.orderIndependentChecksum.enableFullRetryOnMismatch": "true",
}


def run_session(spark: SparkSession, settings: dict[str, str] | None = None) -> SparkSession:
    """A session of its own for one run: no views of other runs, same settings.

    A new session does not inherit settings made at run time, so the ones of the
    calling session are copied first.
    """
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            child.conf.set(key, value)
    for key, value in {**_RUN_SETTINGS, **(settings or {})}.items():
        child.conf.set(key, value)
    return child


def work_root(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="millrace-")
    return _LOCAL_ROOTS[context.applicationId]


def work_path(spark: SparkSession, purpose: str) -> str:
    """A path nobody else uses, under :func:`work_root`."""
    return f"{work_root(spark)}/millrace/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def collected_cuts(made: list[str]) -> Iterator[None]:
    """Paths of all tables that :func:`cut_lineage` writes meanwhile go to ``made``."""
    token = _CUTS.set(made)
    try:
        yield
    finally:
        _CUTS.reset(token)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder, so that what made
    them runs once however often the result is used. A run removes its tables at its
    end, see :func:`collected_cuts`."""
    path = work_path(df.sparkSession, "cut")
    made = _CUTS.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
