"""Pipeline specs: plain dicts, checked before any job starts."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields
from typing import Any
from zoneinfo import ZoneInfo

from millrace import messages
from millrace.errors import SpecError

# Names, sizes and the formats a sink refuses.
NAME_PATTERN = r"^[a-z][a-z0-9_]*$"
SIZE_PATTERN = r"^\s*(\d+(?:\.\d+)?)\s*(B|KB|MB|GB|TB)\s*$"
SIZE_UNITS = {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12}
REFUSED_SINK_SUFFIXES = (".csv", ".tsv", ".json", ".jsonl", ".ndjson")
JOIN_TYPES = ("inner", "left", "right", "full")
SINK_FORMATS = ("parquet", "delta")

_STEP_KEYS = {
    "select": {"columns": list},
    "filter": {"condition": str},
    "aggregate": {"group_by": list, "aggregates": list},
    "join": {"join_type": str, "on": str},
    "python": {"function": str},
}
# Further keys that a step of each type may have.
_STEP_OPTIONS = {
    "join": {"right_path", "right_dataset", "range", "skew_safe", "hot_rows", "tile_rows"},
    "python": {"params", "chunk_rows", "mode", "group_by", "pieces", "schema"},
}
_CHECK_OPTIONS = {"custom_sql": {"must_be"}}
_COMMON_KEYS = {"type", "name", "description"}
_CHECK_KEYS = {
    "not_null": {"columns": list},
    "unique": {"columns": list},
    "row_count_min": {"value": int},
    "accepted_values": {"column": str, "values": list},
    "custom_sql": {"query": str},
}


@dataclass
class PipelineSpec:
    name: str
    sink_path: str
    description: str | None = None
    source_path: str | None = None
    source_type: str = "file"
    source_config: dict[str, Any] | None = None
    sink_format: str = "parquet"
    timezone: str = "UTC"
    partition_by: str | None = None
    checkpointing: bool = False
    # Accepted so that existing specs load; cluster settings decide both.
    threads: int | None = None
    memory_limit: str | None = None
    run_as: str | None = None
    target_file_size: str | None = None
    row_group_size: int | None = None
    transforms: list[dict] = field(default_factory=list)
    checks: list[dict] = field(default_factory=list)
    alerts: dict[str, Any] = field(default_factory=lambda: {"on_failure": "none"})
    # Ours.
    compression: str = "snappy"
    single_file: bool = False
    overwrite: str = "all"
    count_source: bool = True

    @classmethod
    def load(cls, spec: "PipelineSpec | dict") -> "PipelineSpec":
        if isinstance(spec, dict):
            known = {f.name for f in fields(cls)}
            missing = {"name", "sink_path"} - spec.keys()
            if missing:
                raise SpecError(f"missing: {', '.join(sorted(missing))}")
            _refuse_unknown(spec, known, "spec")
            spec = cls(**spec)
        spec.check()
        return spec

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)

    def check(self) -> None:
        _require_name(self.name, "name")
        if self.source_path and not self.source_config:
            self.source_type = "file"
            self.source_config = {"path": self.source_path}
        if not self.source_config:
            raise SpecError(messages.NO_SOURCE)
        if self.sink_format not in SINK_FORMATS:
            raise SpecError(f"sink_format must be one of {', '.join(SINK_FORMATS)}")
        check_sink_path(self.sink_path)
        check_timezone(self.timezone)
        if self.overwrite not in ("all", "partitions"):
            raise SpecError("overwrite must be 'all' or 'partitions'")
        if self.overwrite == "partitions" and not self.partition_by:
            raise SpecError("overwrite 'partitions' needs partition_by")
        if self.single_file and (self.partition_by or self.target_file_size):
            raise SpecError("single_file excludes partition_by and target_file_size")
        for label in ("threads", "row_group_size"):
            value = getattr(self, label)
            if value is not None and value < 1:
                raise SpecError(f"{label} must be at least 1")
        if self.target_file_size is not None:
            if not str(self.target_file_size).strip():
                self.target_file_size = None
            else:
                parse_size(self.target_file_size)
        for step in self.transforms:
            check_step(step)
        for check in self.checks:
            check_check(check)
        _check_alerts(self.alerts)


def sql_texts(spec: PipelineSpec) -> list[str]:
    """Every SQL fragment of a spec."""
    texts = []
    for item in [*spec.transforms, *spec.checks]:
        for value in item.values():
            texts += [str(v) for v in value] if isinstance(value, list) else [str(value)]
    return texts


def parse_size(text: str) -> int:
    """Bytes named by a size such as ``200MB``."""
    match = re.match(SIZE_PATTERN, str(text), re.IGNORECASE)
    if not match:
        raise SpecError(messages.BAD_SIZE)
    return max(1, int(float(match[1]) * SIZE_UNITS[match[2].upper()]))


def check_timezone(zone: str) -> None:
    if zone == "localtime":
        raise SpecError(messages.LOCAL_ZONE)
    try:
        ZoneInfo(zone)
    except (KeyError, ValueError, OSError) as exc:
        raise SpecError(messages.BAD_ZONE.format(zone=zone)) from exc


def check_sink_path(path: str) -> None:
    if not path:
        raise SpecError("sink_path is required")
    if path.lower().endswith(REFUSED_SINK_SUFFIXES):
        raise SpecError(f"sink_path {path!r}: only Parquet and table sinks can be written")


def check_step(step: dict) -> None:
    _require_keys(step, _STEP_KEYS, "step", _STEP_OPTIONS)
    kind = step["type"]
    if kind == "join":
        if step["join_type"] not in JOIN_TYPES:
            raise SpecError(f"join_type must be one of {', '.join(JOIN_TYPES)}")
        if not step.get("right_path") and not step.get("right_dataset"):
            raise SpecError("join needs right_path or right_dataset")
        for rows in ("hot_rows", "tile_rows"):
            if int(step.get(rows, 1)) < 1:
                raise SpecError(f"{rows} must be at least 1")
    if kind == "python":
        _require_name(step["function"], "function")
        if int(step.get("chunk_rows") or 0) < 0:
            raise SpecError("chunk_rows must not be negative")


def check_check(check: dict) -> None:
    _require_keys(check, _CHECK_KEYS, "check", _CHECK_OPTIONS)
    if check["type"] == "row_count_min" and check["value"] < 1:
        raise SpecError("row_count_min value must be at least 1")


def _refuse_unknown(item: dict, known: set, label: str) -> None:
    unknown = set(item) - known
    if unknown:
        raise SpecError(f"{label} does not know {', '.join(sorted(map(str, unknown)))}")


def _require_keys(item: dict, table: dict, label: str, options: dict) -> None:
    kind = item.get("type")
    if kind not in table:
        raise SpecError(f"unknown {label} type {kind!r}; one of {', '.join(table)}")
    for key, wanted in table[kind].items():
        if not isinstance(item.get(key), wanted):
            raise SpecError(f"{label} {kind!r} needs {key} ({wanted.__name__})")
    known = table[kind].keys() | options.get(kind, set()) | _COMMON_KEYS
    _refuse_unknown(item, known, f"{label} {kind!r}")


def _require_name(name: str, label: str) -> None:
    if not isinstance(name, str) or not re.match(NAME_PATTERN, name):
        raise SpecError(f"{label} {name!r} must match {NAME_PATTERN}")


def _check_alerts(alerts: dict) -> None:
    on_failure = alerts.get("on_failure", "none")
    if on_failure not in ("email", "none"):
        raise SpecError("alerts.on_failure must be 'email' or 'none'")
    if on_failure == "email" and not alerts.get("email"):
        raise SpecError(messages.NO_EMAIL)
    floor = alerts.get("on_row_count_below")
    if floor is not None and floor < 1:
        raise SpecError("alerts.on_row_count_below must be at least 1")
