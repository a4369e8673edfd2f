"""Source types by name: each reader turns a config dict into a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace import messages
from millrace.sources.files import probe_files, read_files
from millrace.sources.http import probe_http, read_http

Reader = Callable[[SparkSession, dict], DataFrame]


@dataclass(frozen=True)
class SourceType:
    read: Reader
    probe: Callable[[SparkSession, dict], dict] | None = None
    capabilities: frozenset[str] = frozenset({"source"})


_TYPES: dict[str, SourceType] = {}


def register_source(name: str, source: SourceType) -> None:
    if name in _TYPES:
        raise ValueError(messages.DUPLICATE_SOURCE.format(name=name))
    _TYPES[name] = source


def source_type(name: str) -> SourceType:
    if name not in _TYPES:
        known = ", ".join(sorted(_TYPES))
        raise KeyError(messages.UNKNOWN_SOURCE.format(name=name, known=known))
    return _TYPES[name]


def source_types(capability: str = "source") -> list[str]:
    return sorted(name for name, kind in _TYPES.items() if capability in kind.capabilities)


def read_source(spark: SparkSession, kind: str, config: dict) -> DataFrame:
    return source_type(kind).read(spark, config)


def probe_source(spark: SparkSession, kind: str, config: dict) -> dict:
    """Is the source reachable? connected, message, latency_ms and details."""
    probe = source_type(kind).probe
    if probe is None:
        return {"connected": True, "message": "no probe for this source type",
                "latency_ms": None, "details": {}}
    return probe(spark, config)


register_source("file", SourceType(
    read=lambda spark, config: read_files(
        spark, config["path"], schema=config.get("schema"), options=config.get("options")
    ),
    probe=lambda spark, config: probe_files(spark, config.get("path", "")),
    capabilities=frozenset({"source", "sink"}),
))
register_source("http", SourceType(
    read=read_http,
    probe=lambda spark, config: probe_http(config),
))
