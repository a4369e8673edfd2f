"""File-system calls through the cluster's own Hadoop configuration."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

REMOTE_SCHEMES = ("s3://", "gs://", "gcs://", "http://", "https://")


def is_remote(path: str) -> bool:
    return path.lower().startswith(REMOTE_SCHEMES)


def is_http(path: str) -> bool:
    return path.lower().startswith(("http://", "https://"))


def storage_uri(spark: SparkSession, path: str) -> str:
    """Spell a path the way the configured Hadoop file systems expect it."""
    scheme, sep, rest = path.partition("://")
    if not sep:
        return path
    scheme = scheme.lower()
    if scheme == "gcs":
        scheme = "gs"
    if scheme == "s3" and not _hadoop_conf(spark).get("fs.s3.impl"):
        scheme = "s3a"
    return f"{scheme}://{rest}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _locate(spark, path)
    return fs.exists(target)


def absolute(spark: SparkSession, path: str) -> str:
    """The path as listings spell it, with its scheme."""
    fs, target = _locate(spark, path)
    return fs.makeQualified(target).toString()


def matches(spark: SparkSession, pattern: str) -> int:
    """How many files or folders a path or glob names."""
    fs, target = _locate(spark, pattern)
    found = fs.globStatus(target)
    return len(found) if found is not None else 0


def size_bytes(spark: SparkSession, pattern: str) -> int:
    """Total length of what a path or glob names; 0 when nothing matches."""
    fs, target = _locate(spark, pattern)
    found = fs.globStatus(target)
    if found is None:
        return 0
    return sum(fs.getContentSummary(status.getPath()).getLength() for status in found)


def children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and lengths directly below a folder."""
    fs, target = _locate(spark, path)
    if not fs.exists(target):
        return []
    return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(target))


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    return [(name, size) for name, size in children(spark, path) if name.startswith("part-")]


def parent_of(path: str) -> str:
    head, sep, _ = path.rstrip("/").rpartition("/")
    return head if sep and head else ("/" if sep else ".")


def name_of(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _locate(spark, path)
    fs.mkdirs(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _locate(spark, path)
    if fs.exists(target):
        fs.delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, src = _locate(spark, source)
    _, dst = _locate(spark, target)
    if not fs.rename(src, dst):
        raise OSError(f"could not move {source} to {target}")


def replace(spark: SparkSession, staged: str, target: str) -> None:
    """Put a staged file or folder in the target's place.

    Renames are atomic on HDFS and local disks; object stores copy instead.
    """
    make_folder(spark, parent_of(target))
    aside = f"{parent_of(target)}/_replaced-{name_of(staged)}"
    had_old = exists(spark, target)
    if had_old:
        move(spark, target, aside)
    try:
        move(spark, staged, target)
    except Exception:
        if had_old:
            move(spark, aside, target)
        raise
    if had_old:
        delete(spark, aside)


def has_glob(path: str) -> bool:
    return bool(re.search(r"[*?\[{]", path))


def _hadoop_conf(spark: SparkSession):
    return spark.sparkContext._jsc.hadoopConfiguration()


def _locate(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(storage_uri(spark, path))
    return jvm_path.getFileSystem(_hadoop_conf(spark)), jvm_path
