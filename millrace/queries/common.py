"""What the queries share: the tables of a folder, and steps over them."""

from __future__ import annotations

from millrace.operators.plugins import PluginRegistry
from millrace.plans.runner import pipeline_frame
from millrace.session import run_session, work_path

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def path_of(folder: str, table: str) -> str:
    return f"{folder.rstrip('/')}/{table}.parquet"


def session_with_tables(spark, folder: str, tables=TABLES):
    """A run session in which the tables are views."""
    session = run_session(spark)
    for table in tables:
        session.read.parquet(path_of(folder, table)).createOrReplaceTempView(table)
    return session


def saved(folder: str, *tables: str) -> dict[str, dict]:
    """Saved datasets for tables."""
    return {t: {"type": "file", "config": {"path": path_of(folder, t)}} for t in tables}


def spec(folder: str, table: str, *steps: dict, **settings) -> dict:
    return {
        "name": "query",
        "source_path": path_of(folder, table),
        "sink_path": "unused",
        "transforms": list(steps),
        **settings,
    }


def steps_query(table: str, *steps, datasets=(), plugins=None):
    """A query that is nothing but steps over a table. A step may be a function of
    the folder, for steps that name a path."""

    def run(spark, folder):
        made = [step(folder) if callable(step) else step for step in steps]
        return pipeline_frame(
            spark,
            spec(folder, table, *made),
            datasets=saved(folder, *datasets),
            plugins=PluginRegistry(plugins),
        )

    return run


def sql_query(text: str, tables):
    """An ad-hoc SQL query over some of the tables."""

    def run(spark, folder):
        return session_with_tables(spark, folder, tables).sql(text)

    return run


def select(*columns: str) -> dict:
    return {"type": "select", "columns": list(columns)}


def where(condition: str) -> dict:
    return {"type": "filter", "condition": condition}


def aggregate(group_by, *aggregates: str) -> dict:
    return {"type": "aggregate", "group_by": list(group_by), "aggregates": list(aggregates)}


def join(table: str, how: str, on: str):
    return lambda folder: {
        "type": "join", "right_path": path_of(folder, table), "join_type": how, "on": on,
    }


def scratch(spark, purpose: str) -> str:
    return work_path(spark, purpose)
