"""One run of a pipeline: read, transform, stage, check, publish, record."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from millrace import messages, storage
from millrace.errors import CheckFailure, PipelineError, SpecError, TemplateError
from millrace.operators.access import denied_paths
from millrace.operators.checks import run_checks
from millrace.operators.plugins import PluginRegistry
from millrace.operators.sinks import append_rows, publish, stage
from millrace.operators.steps import apply_step, apply_steps, must_cut
from millrace.params import resolve
from millrace.plans.resume import StepStore
from millrace.session import collected_cuts, cut_lineage, run_session
from millrace.sources import read_source
from millrace.sources.catalog import dataset_paths, register_datasets, resolve_dataset
from millrace.sources.files import require_match
from millrace.spec import PipelineSpec, sql_texts

RUNS_DDL = (
    "run_id string, pipeline_name string, status string, started_at timestamp_ntz, "
    "finished_at timestamp_ntz, rows_extracted bigint, rows_written bigint, "
    "error_message string, warnings array<string>"
)


@dataclass
class RunResult:
    pipeline_name: str
    status: str
    started_at: datetime
    finished_at: datetime
    rows_extracted: int
    rows_written: int
    error_message: str | None = None
    warnings: list[str] = field(default_factory=list)
    run_id: str = ""


def run_pipeline(
    spark: SparkSession,
    spec: PipelineSpec | dict,
    *,
    now: datetime | None = None,
    datasets: dict[str, dict] | None = None,
    roles: DataFrame | None = None,
    plugins: PluginRegistry | None = None,
    runs_path: str | None = None,
) -> RunResult:
    """Run a spec once; raises :class:`PipelineError` naming the failed step.

    ``datasets`` are saved sources by name, also visible to SQL fragments as views;
    ``roles`` is a table ``name, permissions, allow, deny`` for specs with
    ``run_as``; ``runs_path`` is a table folder that gets one row per run.
    """
    started = _utc_now()
    run = _Run(spark, datasets or {}, roles, plugins or PluginRegistry())
    name = spec.name if isinstance(spec, PipelineSpec) else str(spec.get("name"))
    try:
        cuts: list[str] = []
        try:
            with collected_cuts(cuts):
                result = run.execute(spec, now, started)
        finally:
            for path in cuts:
                storage.delete(spark, path)
    except Exception as exc:
        error = exc if isinstance(exc, PipelineError) else PipelineError(name, run.step, str(exc))
        failed = RunResult(name, "failed", started, _utc_now(), run.rows_in, 0, str(error))
        _record(spark, failed, runs_path)
        if error is exc:
            raise
        raise error from exc
    _record(spark, result, runs_path)
    return result


def pipeline_frame(
    spark: SparkSession,
    spec: PipelineSpec | dict,
    *,
    now: datetime | None = None,
    datasets: dict[str, dict] | None = None,
    plugins: PluginRegistry | None = None,
) -> DataFrame:
    """The plan of a spec's source and steps; nothing is published. Joins that keep
    unmatched rows may look at their keys first and write a side to the shared folder,
    where it stays for as long as the plan is used."""
    run = _Run(spark, datasets or {}, None, plugins or PluginRegistry())
    spec = resolve(spec, now)
    df = run.source(spec)
    return apply_steps(df, spec.transforms, plugins=run.plugins, datasets=run.datasets)


class _Run:
    """What one run holds on to; ``step`` is where it is, for the error message."""

    def __init__(self, spark, datasets, roles, plugins):
        self.spark = run_session(spark)
        self.datasets = datasets
        self.roles = roles
        self.plugins = plugins
        self.step = "init"
        self.rows_in = 0

    def execute(self, spec, now, started) -> RunResult:
        self.step = "validate"
        spec = PipelineSpec.load(spec)
        self.step = "template_resolution"
        spec = resolve(spec, now)
        self.step = "data_access"
        check_access(self.spark, spec, self.datasets, self.roles)
        self.step = "source"
        df = self.source(spec, once=True)
        self.step = "extract_count"
        if spec.count_source:
            self.rows_in = df.count()
        store = StepStore(self.spark, spec, self.datasets) if spec.checkpointing else None
        df = self._transform(df, spec, store)

        self.step = "write"
        staged = stage(df, spec)
        try:
            self.step = "quality_check"
            if spec.checks:
                failures = run_checks(staged.read(self.spark), spec.checks, self.spark)
                if failures:
                    raise CheckFailure(failures)
            self.step = "write"
            publish(self.spark, staged, spec)
        finally:
            storage.delete(self.spark, staged.path)
        if store:
            store.clear()
        return RunResult(
            spec.name, "success", started, _utc_now(), self.rows_in, staged.rows,
            warnings=_warnings(spec, staged.rows), run_id=uuid.uuid4().hex,
        )

    def source(self, spec: PipelineSpec, once: bool = False) -> DataFrame:
        """The source as a DataFrame. ``once`` keeps what a remote service answered in
        the shared folder: asking again could give other rows."""
        register_datasets(self.spark, self.datasets, *sql_texts(spec))
        kind, config = _source_of(spec, self.datasets)
        if kind == "file":
            require_match(self.spark, config["path"])
        df = read_source(self.spark, kind, config)
        remote = kind == "http" or any(map(storage.is_http, dataset_paths({"config": config})))
        return cut_lineage(df) if once and remote else df

    def _transform(self, df, spec, store):
        done = store.last_finished() if store else -1
        if done >= 0:
            df = store.load(done)
        for index, step in enumerate(spec.transforms):
            if index <= done:
                continue
            self.step = f"step_{index}"
            if not store and must_cut(step, spec.transforms[:index]):
                df = cut_lineage(df)
            df = apply_step(df, step, plugins=self.plugins, datasets=self.datasets)
            if store:
                df = store.save(index, df)
        return df


def check_access(
    spark: SparkSession, spec: PipelineSpec, datasets: dict[str, dict], roles: DataFrame | None
) -> None:
    """Refuse a spec whose role may not use one of its paths."""
    if not spec.run_as:
        return
    if roles is None:
        raise SpecError(f"run_as '{spec.run_as}' needs a roles table")
    denied = denied_paths(spark, roles, spec.run_as, spec_paths(spec, datasets))
    if denied:
        raise PermissionError(
            messages.NOT_PERMITTED.format(role=spec.run_as, paths=", ".join(denied))
        )


def spec_paths(spec: PipelineSpec, datasets: dict[str, dict]) -> list[str]:
    """Every path a run would touch, saved datasets included."""
    _, config = _source_of(spec, datasets)
    paths = dataset_paths({"config": config}) + [spec.sink_path]
    for step in spec.transforms:
        if step.get("right_path"):
            paths.append(step["right_path"])
        if step.get("right_dataset"):
            paths += dataset_paths(resolve_dataset(step["right_dataset"], datasets))
    return paths


def _source_of(spec: PipelineSpec, datasets: dict[str, dict]) -> tuple[str, dict]:
    saved = spec.source_config.get("connector_name")
    if saved:
        entry = resolve_dataset(saved, datasets)
        return entry.get("type", "file"), entry["config"]
    return spec.source_type, spec.source_config


def _warnings(spec: PipelineSpec, rows: int) -> list[str]:
    floor = spec.alerts.get("on_row_count_below")
    if floor and rows < floor:
        return [f"low row count: {rows} rows written, expected at least {floor}"]
    return []


def _record(spark, result: RunResult, runs_path: str | None) -> None:
    if not runs_path:
        return
    row = (
        result.run_id or uuid.uuid4().hex, result.pipeline_name, result.status,
        result.started_at, result.finished_at, result.rows_extracted, result.rows_written,
        result.error_message, result.warnings,
    )
    append_rows(spark, [row], RUNS_DDL, runs_path)


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


__all__ = ["PipelineError", "RunResult", "TemplateError", "pipeline_frame", "run_pipeline"]
