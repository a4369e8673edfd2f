"""Incremental runs: new files since the last run, checked, then published."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace import storage
from millrace.errors import CheckFailure, PipelineError, SinkError, SpecError
from millrace.operators.checks import run_checks
from millrace.operators.plugins import PluginRegistry, plugin_mode
from millrace.operators.sinks import write_parquet
from millrace.operators.steps import apply_step
from millrace.params import resolve
from millrace.plans.runner import check_access
from millrace.session import collected_cuts, run_session
from millrace.sources.catalog import register_datasets, resolve_dataset
from millrace.sources.files import detect_format
from millrace.spec import PipelineSpec, sql_texts

BATCH_COLUMN = "batch_id"


@dataclass
class IncrementalResult:
    batches: int
    rows_written: int


def run_incremental(
    spark: SparkSession,
    spec: PipelineSpec | dict,
    checkpoint: str,
    *,
    schema=None,
    datasets: dict[str, dict] | None = None,
    plugins: PluginRegistry | None = None,
    roles: DataFrame | None = None,
) -> IncrementalResult:
    """Process the source files that no earlier run has seen, then stop.

    Row-wise steps append: every micro-batch is checked and written to a folder of
    its own (``batch_id=<owner>-<n>``), so a repeated batch replaces itself. The owner
    is the checkpoint. The first batch of a new checkpoint takes all source files again
    and so replaces the whole sink; a later one refuses a sink that has come to another
    checkpoint since. A spec that ends in an aggregation keeps running totals in
    streaming state and replaces the sink with the new totals. ``checkpoint`` is a
    folder all executors share; ``roles`` is needed for specs with ``run_as``.
    """
    spec = resolve(spec)
    for setting, plain in (("sink_format", "parquet"), ("overwrite", "all"),
                           ("single_file", False), ("target_file_size", None)):
        if getattr(spec, setting) != plain:
            raise SpecError(f"an incremental run cannot keep {setting}")
    session = run_session(spark)
    check_access(session, spec, datasets or {}, roles)
    owner = hashlib.sha256(storage.absolute(session, checkpoint).encode()).hexdigest()[:12]
    register_datasets(session, datasets or {}, *sql_texts(spec))
    total = _aggregates(spec)
    df = _stream(session, _source_path(spec, datasets or {}), schema)
    cuts: list[str] = []
    with collected_cuts(cuts):
        for step in spec.transforms:
            df = apply_step(df, step, plugins=plugins, datasets=datasets)
    result = IncrementalResult(0, 0)

    def publish(batch: DataFrame, batch_id: int) -> None:
        folder = None if total else f"{BATCH_COLUMN}={owner}-{batch_id}"
        if folder:
            _check_owner(session, spec.sink_path, owner, batch_id)
        result.rows_written += _checked_write(batch, spec, folder, whole=batch_id == 0)
        result.batches += 1

    query = (
        df.writeStream.foreachBatch(publish)
        .outputMode("complete" if total else "append")
        .option("checkpointLocation", storage.storage_uri(spark, checkpoint))
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except Exception as exc:
        raise PipelineError(spec.name, "incremental", str(exc)) from exc
    finally:
        for path in cuts:
            storage.delete(spark, path)
    return result


def read_incremental(spark: SparkSession, path: str) -> DataFrame:
    """What row-wise incremental runs have published so far."""
    return spark.read.parquet(storage.storage_uri(spark, path)).drop(BATCH_COLUMN)


def _source_path(spec: PipelineSpec, datasets: dict[str, dict]) -> str:
    saved = spec.source_config.get("connector_name")
    config = resolve_dataset(saved, datasets)["config"] if saved else spec.source_config
    if "path" not in config:
        raise SpecError("an incremental run reads files; the source needs a path")
    return config["path"]


def _stream(session: SparkSession, path: str, schema) -> DataFrame:
    path = storage.storage_uri(session, path)
    fmt = detect_format(path)
    if schema is None:
        if fmt != "parquet":
            raise SpecError("an incremental CSV or JSON source needs a schema")
        schema = session.read.parquet(path).schema
    reader = session.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    folder, _, last = path.rstrip("/").rpartition("/")
    if storage.has_glob(last):
        reader, path = reader.option("pathGlobFilter", last), folder
    return reader.load(path)


def _aggregates(spec: PipelineSpec) -> bool:
    kinds = [step["type"] for step in spec.transforms]
    if "aggregate" in kinds[:-1]:
        raise SpecError("an incremental run can aggregate in its last step only")
    if any(plugin_mode(step) != "chunk" for step in spec.transforms if step["type"] == "python"):
        raise SpecError("an incremental run takes row-wise plugins only")
    return bool(kinds) and kinds[-1] == "aggregate"


def _check_owner(session: SparkSession, sink: str, owner: str, batch_id: int) -> None:
    """Refuse a sink that holds anything but batches, or later batches of another's."""
    mine = f"{BATCH_COLUMN}={owner}-" if batch_id else f"{BATCH_COLUMN}="
    for name, _ in storage.children(session, sink):
        if not name.startswith((mine, "_", ".")):
            raise SinkError(f"{sink}: {name} was not written from this checkpoint")


def _checked_write(batch: DataFrame, spec: PipelineSpec, folder: str | None, whole: bool) -> int:
    """Stage and check a micro-batch, then publish it as one folder or as the whole sink."""
    session = batch.sparkSession
    name = storage.name_of(spec.sink_path)
    staging = f"{storage.parent_of(spec.sink_path)}/_staging-{name}-{uuid.uuid4().hex}"
    written = f"{staging}/{folder}" if folder else staging
    try:
        rows = write_parquet(batch, written, partition_by=spec.partition_by,
                             compression=spec.compression, row_group_size=spec.row_group_size)
        if spec.checks:
            failures = run_checks(session.read.schema(batch.schema).parquet(written), spec.checks,
                                  session)
            if failures:
                raise CheckFailure(failures)
        if folder and not whole:
            storage.replace(session, written, f"{spec.sink_path}/{folder}")
        else:
            storage.replace(session, staging, spec.sink_path)
    finally:
        storage.delete(session, staging)
    return rows
