"""What is there: schemas of datasets and of folders, and saved dataset names."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import messages
from millrace.sources import read_source
from millrace.sources.files import list_files, read_files

_DESCRIBE_SCHEMA = "path string, column string, type string, position int"


def describe_files(spark: SparkSession, paths: list[str], *, errors: bool = False) -> DataFrame:
    """One row per column of each path. A path that cannot be read gives none, or with
    ``errors`` one row that says why in a further column ``error``."""
    rows = []
    for path in paths:
        try:
            schema = read_files(spark, path).schema
        except (AnalysisException, OSError, PySparkException, Py4JJavaError) as exc:
            rows.append((path, None, None, None, str(exc)))
            continue
        rows += [
            (path, f.name, f.dataType.simpleString(), i, None) for i, f in enumerate(schema.fields)
        ]
    found = spark.createDataFrame(rows, f"{_DESCRIBE_SCHEMA}, error string")
    return found if errors else found.where("error IS NULL").drop("error")


def catalog(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Schemas of the datasets below a folder.

    ``part-*`` files of one folder, with its ``key=value`` folders, are one dataset;
    any other file is one by itself. The number of datasets follows the layout, not
    the data, so the driver reads one schema for each. ``limit`` keeps the first few.
    """
    files = list_files(spark, folder, "*.{parquet,csv,json}")
    parent = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]+$", 1), r"(/[^/=]+=[^/]*)+$", "")
    suffix = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    # Parquet folders are read as such, with their partition columns.
    part = F.when(suffix == "parquet", parent).otherwise(F.concat(parent, F.lit("/*."), suffix))
    datasets = files.select(
        F.when(F.col("path").rlike(r"/part-[^/]*$"), part).otherwise(F.col("path")).alias("dataset")
    ).distinct().orderBy("dataset")
    if limit is not None:
        datasets = datasets.limit(limit)
    return describe_files(spark, [row["dataset"] for row in datasets.toLocalIterator()])


def named_dataset(spark: SparkSession, name: str, saved: dict[str, dict]) -> DataFrame:
    """A saved source by name: ``{name: {"type": ..., "config": {...}}}``."""
    entry = resolve_dataset(name, saved)
    return read_source(spark, entry.get("type", "file"), entry["config"])


def resolve_dataset(name: str, saved: dict[str, dict]) -> dict:
    if name not in saved:
        raise LookupError(messages.NO_DATASET.format(name=name))
    return saved[name]


def register_datasets(spark: SparkSession, saved: dict[str, dict], *texts: str) -> None:
    """The saved datasets that SQL texts name, as temporary views of this session."""
    for name in named_in(saved, *texts):
        named_dataset(spark, name, saved).createOrReplaceTempView(name)


def named_in(saved: dict[str, dict], *texts: str) -> list[str]:
    """The saved datasets that SQL texts name."""
    return [name for name in saved
            if any(re.search(rf"\b{re.escape(name)}\b", text, re.I) for text in texts)]


def dataset_paths(saved_entry: dict) -> list[str]:
    config = saved_entry.get("config", {})
    found: list[str] = []
    for key in ("path", "url", "urls"):
        value = config.get(key) or []
        found += [value] if isinstance(value, str) else list(value)
    return found
