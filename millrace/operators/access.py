"""Roles, prefix scopes and permissions as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.paths import WILDCARD, path_allowed, s3_paths

# Every permission key the wildcard stands for.
ALL_PERMISSIONS = (
    "dashboard.view",
    "pipelines.view", "pipelines.create", "pipelines.edit", "pipelines.delete", "pipelines.run",
    "connectors.view", "connectors.create", "connectors.edit", "connectors.delete",
    "cronjobs.view", "cronjobs.create", "cronjobs.edit", "cronjobs.delete", "cronjobs.run",
    "query.run",
    "flux.ask",
    "users.manage", "roles.manage", "settings.manage", "audit.view",
)

ROLES_DDL = "name string, permissions array<string>, allow array<string>, deny array<string>"


def scope_paths(paths: DataFrame, roles: DataFrame) -> DataFrame:
    """``paths`` (with ``role, path``) plus ``allowed``; an unknown role is free.

    The roles table is joined without a hint: when it is measured small it is
    broadcast at run time, otherwise a hot role is split on the side of the paths.
    """
    scopes = roles.select(
        F.col("name").alias("_role"), F.col("permissions").alias("_permissions"),
        F.col("allow").alias("_allow"), F.col("deny").alias("_deny"),
    )
    allowed = path_allowed(F.col("path"), F.col("_permissions"), F.col("_allow"), F.col("_deny"))
    return paths.join(scopes, F.col("role") == F.col("_role"), "left").select(
        *paths.columns, allowed.alias("allowed")
    )


def paths_in_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per ``s3://`` path a text names; texts without any give none."""
    kept = [c for c in texts.columns if c != text]
    return texts.select(*kept, F.explode(s3_paths(F.col(text))).alias("path"))


def denied_report(texts: DataFrame, roles: DataFrame) -> DataFrame:
    """Distinct ``role, path`` pairs that texts (``role, text``) may not touch."""
    return (
        scope_paths(paths_in_texts(texts.select("role", "text")), roles)
        .where(~F.col("allowed"))
        .select("role", "path")
        .distinct()
    )


def denied_paths(spark: SparkSession, roles: DataFrame, role: str, paths: list[str]) -> list[str]:
    """The ones of a spec's few paths that a role may not touch, in order."""
    asked = spark.createDataFrame(
        [(i, role, path) for i, path in enumerate(paths)], "position int, role string, path string"
    )
    rows = scope_paths(asked, roles).where(~F.col("allowed"))
    return [row["path"] for row in rows.orderBy("position").collect()]


def denied_in_texts(
    spark: SparkSession, roles: DataFrame, role: str, texts: list[str]
) -> list[str]:
    asked = spark.createDataFrame([(role, text) for text in texts], "role string, text string")
    rows = denied_report(asked, roles).orderBy("path")
    return [row["path"] for row in rows.collect()]


def expand_permissions(roles: DataFrame) -> DataFrame:
    """One row per role and permission; the wildcard stands for every key."""
    every = F.array(*map(F.lit, ALL_PERMISSIONS))
    granted = F.when(F.array_contains("permissions", WILDCARD), every).otherwise(
        F.array_distinct("permissions")
    )
    return roles.select(F.col("name").alias("role"), F.explode(granted).alias("permission"))


def with_permission(users: DataFrame, roles: DataFrame, permission: str) -> DataFrame:
    """Users (with ``role``) whose role grants a permission."""
    granting = (
        expand_permissions(roles).where(F.col("permission") == permission).select("role").distinct()
    )
    return users.join(granting, "role", "left_semi")


