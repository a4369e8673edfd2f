"""Sinks: stage on the target's file system, check, then publish by rename."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from millrace import messages, storage
from millrace.errors import SinkError
from millrace.session import run_session
from millrace.spec import PipelineSpec, check_sink_path, parse_size

SINGLE_FILE_LIMIT = 2 * 10**9


@dataclass
class Staged:
    """A complete result that nobody reads yet."""

    path: str
    schema: StructType
    rows: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def stage(df: DataFrame, spec: PipelineSpec) -> Staged:
    """Write the plan once, next to the target, counting rows on the way."""
    spark = df.sparkSession
    parent, name = storage.parent_of(spec.sink_path), storage.name_of(spec.sink_path)
    path = f"{parent}/_staging-{name}-{uuid.uuid4().hex}"
    try:
        rows = write_parquet(
            df,
            path,
            partition_by=spec.partition_by,
            compression=spec.compression,
            row_group_size=spec.row_group_size,
        )
    except Exception:
        storage.delete(spark, path)
        raise
    return Staged(path, df.schema, rows)


def _without_empty_values(df: DataFrame, column: str) -> DataFrame:
    """``df``, failing on rows whose partition value is the empty text."""
    value = F.col(f"`{column}`")
    texts = [f.name for f in df.schema if f.name.lower() == column.lower() and isinstance(f.dataType, StringType)]
    refused = F.raise_error(F.lit(messages.EMPTY_PARTITION.format(column=column)))
    return df.withColumns({name: F.when(value == "", refused).otherwise(value) for name in texts}) if texts else df


def write_parquet(
    df: DataFrame,
    path: str,
    *,
    partition_by: str | None = None,
    compression: str = "zstd",
    row_group_size: int | None = None,
    max_file_rows: int | None = None,
    mode: str = "error",
) -> int:
    """Write Parquet and return the number of rows written.

    With ``partition_by`` the rows are first rebalanced on that column, so a value
    lands in few files; the adaptive planner splits a value that holds much of the
    data and joins small ones. An empty text fails there, since a folder name has no place
    for it and it would be read as null. The count is taken in the writing stage itself.
    """
    if partition_by:
        df = _without_empty_values(df, partition_by)
        df = df.hint("rebalance", partition_by)
    counted = Observation(f"rows_{uuid.uuid4().hex}")
    writer = (
        df.observe(counted, F.count(F.lit(1)).alias("rows"))
        .write.mode(mode)
        .option("compression", compression)
    )
    if row_group_size:
        # Rows per group exactly; the byte limit must not cut a group earlier.
        writer = writer.option("parquet.block.row.count.limit", row_group_size)
    if max_file_rows:
        writer = writer.option("maxRecordsPerFile", max_file_rows)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(storage.storage_uri(df.sparkSession, path))
    return counted.get["rows"]


def publish(spark: SparkSession, staged: Staged, spec: PipelineSpec) -> None:
    """Put the staged result in the target's place."""
    if spec.sink_format != "parquet":
        write_table(staged.read(spark), spec)
    elif spec.overwrite == "partitions":
        if spec.target_file_size:
            _resize(spark, staged, spec)
        # A rename for each partition of the result; their files stay as they are.
        for name, _ in storage.children(spark, staged.path):
            if name.startswith(f"{spec.partition_by}="):
                storage.replace(spark, f"{staged.path}/{name}", f"{spec.sink_path}/{name}")
    elif spec.single_file:
        _publish_single(spark, staged, spec)
    else:
        if spec.target_file_size:
            _resize(spark, staged, spec)
        storage.replace(spark, staged.path, spec.sink_path)


def write_table(df: DataFrame, spec: PipelineSpec) -> None:
    """Full overwrite of a versioned table, if its data source is installed."""
    writer = df.write.format(spec.sink_format).mode("overwrite")
    if spec.partition_by:
        writer = writer.partitionBy(spec.partition_by)
    try:
        writer.save(storage.storage_uri(df.sparkSession, spec.sink_path))
    except Exception as exc:
        if "DATA_SOURCE_NOT_FOUND" in str(exc):
            raise SinkError(
                f"sink_format '{spec.sink_format}' needs its data source on the cluster's classpath"
            ) from exc
        raise


def append_rows(spark: SparkSession, rows: list[tuple], ddl: str, path: str) -> None:
    """Append a few driver-side rows, such as a run record, to a table folder."""
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(
        storage.storage_uri(spark, path)
    )


def staged_overwrite(df: DataFrame, path: str, **options) -> int:
    """Replace a table folder by a result that may be computed from that folder."""
    check_sink_path(path)
    spark = df.sparkSession
    staging = f"{storage.parent_of(path)}/_staging-{storage.name_of(path)}-{uuid.uuid4().hex}"
    rows = write_parquet(df, staging, **options)
    storage.replace(spark, staging, path)
    return rows


def _resize(spark: SparkSession, staged: Staged, spec: PipelineSpec) -> None:
    """Bring the staged files to the wanted size.

    The staged files give the real bytes per row. Sizes that already fit are left
    alone; otherwise the files are read again in splits of the wanted size, which
    packs small ones and divides large ones without a shuffle.
    """
    target = parse_size(spec.target_file_size)
    total = storage.size_bytes(spark, staged.path)
    if staged.rows == 0 or total == 0:
        return
    if spec.partition_by is None:
        sizes = [size for _, size in storage.data_files(spark, staged.path)]
        if max(sizes) <= 1.25 * target and sum(sizes) / len(sizes) >= 0.5 * target:
            return
    per_file = max(1, int(target * staged.rows / total))
    sized = run_session(spark, {
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.files.openCostInBytes": str(min(target, 4096)),
        "spark.sql.files.minPartitionNum": "1",
    })
    resized = f"{staged.path}-sized"
    rows = write_parquet(
        staged.read(sized),
        resized,
        partition_by=spec.partition_by,
        compression=spec.compression,
        row_group_size=spec.row_group_size,
        max_file_rows=per_file,
    )
    if rows != staged.rows:
        raise SinkError(f"resizing changed the row count from {staged.rows} to {rows}")
    storage.replace(spark, resized, staged.path)


def _publish_single(spark: SparkSession, staged: Staged, spec: PipelineSpec) -> None:
    """One Parquet file instead of a folder, for results of a checked size."""
    total = storage.size_bytes(spark, staged.path)
    if total > SINGLE_FILE_LIMIT:
        raise SinkError(
            f"single_file: the result has {total} bytes, more than {SINGLE_FILE_LIMIT}; "
            "write a folder instead"
        )
    source = staged.path
    if len(storage.data_files(spark, source)) != 1:
        source = f"{staged.path}-single"
        write_parquet(staged.read(spark).coalesce(1), source, compression=spec.compression,
                      row_group_size=spec.row_group_size)
    (name, _), = storage.data_files(spark, source)
    storage.replace(spark, f"{source}/{name}", spec.sink_path)
    for folder in {source, staged.path}:
        storage.delete(spark, folder)
