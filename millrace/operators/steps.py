"""Transform steps: each takes a DataFrame and returns the next one, lazily."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import storage
from millrace.operators.joins import (
    HOT_ROWS, condition_keys, join_step, needs_left_twice, range_bounds, range_join_step,
)
from millrace.operators.plugins import PluginRegistry, plugin_step
from millrace.operators.tiles import TILE_ROWS, theta_join_step
from millrace.session import cut_lineage
from millrace.sources.catalog import dataset_paths, named_dataset
from millrace.sources.files import read_files
from millrace.spec import check_step

# Up to this size a right side is counted, to learn that no key of it can be hot.
COUNTED_BYTES = 8 * 10**9

# Words of a fragment whose result may depend on the order rows arrive in.
_UNREPEATABLE = re.compile(
    r"\b(over|limit|distinct|tablesample|rand|randn|random|uuid|shuffle|first|last|any_value"
    r"|monotonically_increasing_id|spark_partition_id)\b",
    re.I,
)


def select_step(df: DataFrame, columns: list[str]) -> DataFrame:
    """A projection of SQL expressions; ``*`` and a leading DISTINCT work."""
    with _view(df) as name:
        return df.sparkSession.sql(f"SELECT {', '.join(columns)} FROM {name}")


def filter_step(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the predicate is true; subqueries may name views."""
    with _view(df) as name:
        return df.sparkSession.sql(f"SELECT * FROM {name} WHERE {condition}")


def aggregate_step(df: DataFrame, group_by: list[str], aggregates: list[str]) -> DataFrame:
    """Group columns, then aggregates; no group columns gives one row."""
    return df.groupBy(*map(F.expr, group_by)).agg(*map(F.expr, aggregates))


def apply_step(
    df: DataFrame,
    step: dict,
    *,
    plugins: PluginRegistry | None = None,
    datasets: dict[str, dict] | None = None,
) -> DataFrame:
    """One step of a spec."""
    check_step(step)
    kind = step["type"]
    if kind == "select":
        return select_step(df, step["columns"])
    if kind == "filter":
        return filter_step(df, step["condition"])
    if kind == "aggregate":
        return aggregate_step(df, step["group_by"], step["aggregates"])
    if kind == "join":
        return _join(df, step, datasets or {})
    return plugin_step(df, step, plugins or PluginRegistry())


def apply_steps(df: DataFrame, steps: Iterable[dict], **context) -> DataFrame:
    """All steps in order; the optimizer sees them as one plan, but for the left sides
    that :func:`must_cut` names, which are written to the shared folder first."""
    before: list[dict] = []
    for step in steps:
        if must_cut(step, before):
            df = cut_lineage(df)
        df = apply_step(df, step, **context)
        before.append(step)
    return df


def must_cut(step: dict, before: list[dict]) -> bool:
    """A right or full join reads its left side twice. That is cheap and safe for row
    by row steps; anything else is written once, so that it is neither repeated nor
    able to give other rows the second time."""
    if step.get("type") != "join":
        return False
    twice = needs_left_twice(
        step.get("join_type"), step.get("on", ""), step.get("skew_safe", True)
    )
    return twice and not all(map(_repeatable, before))


def _repeatable(step: dict) -> bool:
    if step["type"] not in ("select", "filter"):
        return False
    return not _UNREPEATABLE.search(" ".join(step.get("columns", [step.get("condition", "")])))


def _join(df: DataFrame, step: dict, datasets: dict[str, dict]) -> DataFrame:
    spark = df.sparkSession
    if step.get("right_dataset"):
        right = named_dataset(spark, step["right_dataset"], datasets)
        paths = dataset_paths(datasets[step["right_dataset"]])
    else:
        right = read_files(spark, step["right_path"])
        paths = [step["right_path"]]
    if any(storage.is_http(path) for path in paths):
        right = cut_lineage(right)
    on, how, skew_safe = step["on"], step["join_type"], step.get("skew_safe", True)
    if step.get("range"):
        return range_join_step(df, right, on, how, **step["range"])
    bounds = range_bounds(on, df, right) if skew_safe and not df.isStreaming else None
    if bounds:
        side, point, low, high = bounds
        return range_join_step(df, right, on, how, point, low, high, side=side)
    size = _measured(spark, paths)
    small = 0 < size <= _broadcast_limit(spark)
    if skew_safe and not df.isStreaming and condition_keys(on) is None:
        # A small right side is compared where the left rows are, if no side is to be kept there.
        if step.get("tile_rows") or not (small and how in ("inner", "left")):
            return theta_join_step(df, right, on, how, int(step.get("tile_rows", TILE_ROWS)))
    hot_rows = int(step.get("hot_rows", HOT_ROWS))
    return join_step(
        df,
        right,
        on,
        how,
        right_is_small=small,
        right_may_be_hot=not (skew_safe and 0 < size <= COUNTED_BYTES
                              and right.count() <= hot_rows),
        skew_safe=skew_safe,
        hot_rows=hot_rows,
    )


def _measured(spark, paths: list[str]) -> int:
    """Bytes of the files, 0 when they cannot be measured."""
    if any(storage.is_http(path) for path in paths):
        return 0
    return sum(storage.size_bytes(spark, path) for path in paths)


def _broadcast_limit(spark) -> int:
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    units = {"k": 10, "m": 20, "g": 30}
    text = text.lower().removesuffix("b")
    return int(text[:-1]) << units[text[-1]] if text[-1:] in units else int(text)


@contextmanager
def _view(df: DataFrame) -> Callable:
    """A view under a name of its own for as long as a statement is analysed."""
    name = f"_step_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)
