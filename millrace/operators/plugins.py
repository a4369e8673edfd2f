"""Python steps: Arrow table in, Arrow table out, run inside Spark tasks.

A plugin is ``transform(table, params) -> table`` over ``pyarrow.Table``, called in
parallel with at most ``chunk_rows`` rows. One that needs all rows, of its group or of
the input, is a :class:`StagedPlugin`: it makes a small state from any part of the rows,
merges states, and finishes each part of the rows with the merged state of its group.
So no group has to fit in a task, however many rows it has.

* chunk (``chunk_rows`` is set): plain plugins, any rows in a call;
* group (``group_by`` is set): staged plugins, one state per key. A plain plugin may run
  on pieces of groups with ``pieces: true``; it then must not need the whole group;
* whole (neither is set): staged plugins, one state.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from millrace import messages
from millrace.errors import PluginError
from millrace.session import cut_lineage
from millrace.spec import NAME_PATTERN

Plugin = Callable[[pa.Table, dict[str, Any]], pa.Table]

DEFAULT_CHUNK_ROWS = 100_000
# Keys whose states a task holds before it hands them on.
HELD_STATES = 10_000
# Tasks whose states are merged in one further task, where all rows have one state.
MERGED_STATES = 256
# Rows of a group that are joined with its state in one task, where states are exchanged.
GROUP_ROWS = 1_000_000


@dataclass(frozen=True)
class StagedPlugin:
    """``partial(table, params)`` gives one state row for some rows of a group,
    ``merge(states, params)`` one state row for several, in any order and grouping, and
    ``finish(table, params)`` the result rows; its table has the state's columns beside
    each row. States have as few bytes as the answer allows; they are all that meets."""

    partial: Callable[[pa.Table, dict[str, Any]], pa.Table]
    merge: Callable[[pa.Table, dict[str, Any]], pa.Table]
    finish: Callable[[pa.Table, dict[str, Any]], pa.Table]

    def __call__(self, table: pa.Table, params: dict[str, Any]) -> pa.Table:
        """The whole path on one table."""
        state = self.merge(self.partial(table, params), params)
        for name in state.column_names:
            column = pa.concat_arrays([state.column(name).combine_chunks().slice(0, 1)] * table.num_rows) \
                if table.num_rows else state.column(name).slice(0, 0)
            table = table.append_column(name, column)
        return self.finish(table, params)


class PluginRegistry:
    """Plugins by name. Specs hold names only, never code."""

    def __init__(self, plugins: dict[str, Plugin] | None = None):
        self._plugins: dict[str, Plugin] = {}
        for name, function in (plugins or {}).items():
            self.register(name, function)

    def register(self, name: str, function: Plugin) -> None:
        _require_plugin_name(name)
        self._plugins[name] = function

    def names(self) -> list[str]:
        return sorted(self._plugins)

    def load(self, name: str) -> Plugin:
        _require_plugin_name(name)
        if name not in self._plugins:
            known = ", ".join(self.names()) or "(none)"
            raise PluginError(messages.UNKNOWN_PLUGIN.format(name=name, known=known))
        if not callable(self._plugins[name]):
            raise PluginError(messages.NOT_CALLABLE.format(name=name))
        return self._plugins[name]


def _require_plugin_name(name: str) -> None:
    if not re.match(NAME_PATTERN, name):
        raise PluginError(messages.BAD_PLUGIN_NAME.format(name=name))


def call_plugin(name: str, function: Plugin, table: pa.Table, params: dict) -> pa.Table:
    result = function(table, params)
    if not isinstance(result, pa.Table):
        raise PluginError(messages.NOT_A_TABLE.format(name=name, kind=type(result).__name__))
    return result


def plugin_step(df: DataFrame, step: dict, plugins: PluginRegistry) -> DataFrame:
    """``{function, params, chunk_rows, mode, group_by, pieces, schema}``."""
    name = step["function"]
    function = plugins.load(name)
    params = step.get("params") or {}
    chunk_rows = int(step.get("chunk_rows") or 0) or DEFAULT_CHUNK_ROWS
    mode = plugin_mode(step)
    shape = _Shape.of(df, name, function, params, step.get("schema"))
    keys = list(step.get("group_by") or []) if mode == "group" else []
    if mode in ("whole", "group") and isinstance(function, StagedPlugin):
        return _run_staged(df, name, function, params, shape, keys, chunk_rows)
    if mode == "group" and step.get("pieces"):
        return _run_grouped(df, name, function, params, shape, keys, chunk_rows)
    if mode in ("whole", "group"):
        raise PluginError(
            f"Plugin '{name}': to see all rows it must be a StagedPlugin; "
            "a plain one needs chunk_rows, or group_by with pieces")
    if mode != "chunk":
        raise PluginError(f"Plugin '{name}': mode must be chunk, group or whole, got {mode!r}")
    return df.mapInArrow(
        _over_chunks(name, function, params, shape, chunk_rows), shape.spark_schema
    )


def plugin_mode(step: dict) -> str:
    if step.get("mode"):
        return step["mode"]
    if step.get("group_by"):
        return "group"
    return "chunk" if step.get("chunk_rows") else "whole"


def row_chunks(
    df: DataFrame, name: str, function: Plugin, params: dict, chunk_rows: int, schema=None
) -> DataFrame:
    """Calls over exact slices ``[k*n, (k+1)*n)`` of each Parquet file's rows, in
    file order. ``df`` is a plain file scan; one slice is one group of at most
    ``chunk_rows`` rows."""
    if chunk_rows <= 0:
        raise ValueError("chunk_rows must be positive")
    shape = _Shape.of(df, name, function, params, schema)
    placed = df.select(
        *df.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
        F.floor(F.col("_metadata.row_index") / chunk_rows).alias("_chunk"),
    )

    def run(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("_row").drop_columns(["_file", "_row", "_chunk"])
        return shape.conform(name, call_plugin(name, function, ordered, params))

    return placed.groupBy("_file", "_chunk").applyInArrow(run, shape.spark_schema)


class _Shape:
    """Input and output schemas, learned from one call on a table without rows."""

    def __init__(self, arrow_in: pa.Schema, arrow_out: pa.Schema, spark_schema: StructType):
        self.arrow_in = arrow_in
        self.arrow_out = arrow_out
        self.spark_schema = spark_schema

    @classmethod
    def of(cls, df, name, function, params, declared) -> "_Shape":
        spark: SparkSession = df.sparkSession
        empty = spark.createDataFrame([], df.schema).toArrow()
        if declared is None:
            result = spark.createDataFrame(call_plugin(name, function, empty, params))
        else:
            result = spark.createDataFrame([], declared)
        return cls(empty.schema, result.limit(0).toArrow().schema, result.schema)

    def given(self, batches) -> pa.Table:
        """Batches as the plugin was shown them; nullability and the spelling of time
        zones may differ by where a column comes from."""
        return pa.Table.from_batches(batches).cast(
            pa.schema([pa.field(f.name, f.type) for f in self.arrow_in]))

    def conform(self, name: str, table: pa.Table) -> pa.Table:
        if table.column_names != self.arrow_out.names:
            raise PluginError(
                f"Plugin '{name}' returned columns {table.column_names}, "
                f"expected {self.arrow_out.names}; all slices must have one schema"
            )
        try:
            return table.cast(self.arrow_out)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as exc:
            raise PluginError(f"Plugin '{name}': {exc}") from exc


def _over_chunks(name, function, params, shape, chunk_rows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _cut(batches, chunk_rows):
            table = shape.given(piece)
            yield from shape.conform(
                name, call_plugin(name, function, table, params)
            ).to_batches()

    return run


def _cut(batches, chunk_rows) -> Iterator[list[pa.RecordBatch]]:
    """Regroup a stream of batches into lists of exactly ``chunk_rows`` rows."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, chunk_rows - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == chunk_rows:
                yield held
                held, rows = [], 0
    if held:
        yield held


def _run_grouped(df, name, function, params, shape, group_by, chunk_rows):
    """Rows of one key meet in order in a task and are cut into bounded pieces.

    Groups above ``chunk_rows`` rows have to be cut anyway, so their rows are dealt
    out to several tasks instead of meeting in one; copies of one row spread too.
    """
    counts = df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("_rows"))
    large = counts.where(F.col("_rows") > chunk_rows).select(
        *[F.col(c).alias(f"_large_{c}") for c in group_by],
        F.ceil(F.col("_rows") / chunk_rows).alias("_parts"),
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_large_{c}")) for c in group_by])
    part = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")), F.lit(0))
    arranged = (
        df.join(large, same, "left")
        .select(*df.columns, part.alias("_part"))
        .repartition(*map(F.col, group_by), F.col("_part"))
        .sortWithinPartitions(*group_by)
        .drop("_part")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _cut_groups(batches, group_by, chunk_rows):
            table = shape.given(piece)
            yield from shape.conform(
                name, call_plugin(name, function, table, params)
            ).to_batches()

    return arranged.mapInArrow(run, shape.spark_schema)


def _cut_groups(batches, group_by, chunk_rows) -> Iterator[list[pa.RecordBatch]]:
    """Runs of equal keys in a sorted stream, each cut at ``chunk_rows`` rows."""
    held, rows, current = [], 0, None
    for batch in batches:
        for start, end, key in _runs(batch, group_by):
            if rows and not _same(key, current):
                yield held
                held, rows = [], 0
            current = key
            while start < end:
                take = min(end - start, chunk_rows - rows)
                held.append(batch.slice(start, take))
                start, rows = start + take, rows + take
                if rows == chunk_rows:
                    yield held
                    held, rows = [], 0
    if held:
        yield held


def _same(one: tuple, other: tuple) -> bool:
    return all(a == b or a != a and b != b for a, b in zip(one, other))


def _runs(batch: pa.RecordBatch, group_by) -> Iterator[tuple[int, int, tuple]]:
    encoded = [batch.column(c).dictionary_encode("encode").indices.to_numpy() for c in group_by]
    changed = [0]
    if batch.num_rows:
        differs = False
        for codes in encoded:
            differs = differs | (codes[1:] != codes[:-1])
        changed += (differs.nonzero()[0] + 1).tolist()
    for start, end in zip(changed, changed[1:] + [batch.num_rows]):
        if start < end:
            yield start, end, tuple(batch.column(c)[start].as_py() for c in group_by)


def _run_staged(df, name, plugin, params, shape, keys, chunk_rows):
    """States per key from every task, merged by key, joined back, rows finished."""
    spark = df.sparkSession
    empty = pa.Table.from_batches([], shape.arrow_in)
    state = spark.createDataFrame(plugin.merge(plugin.partial(empty, params), params)).schema
    taken = set(df.columns) & set(state.fieldNames())
    if taken:
        raise PluginError(f"Plugin '{name}': state columns {sorted(taken)} are input columns")
    named = [f"_key{i}" for i in range(len(keys))]
    keyed = StructType([StructField(n, df.schema[k].dataType) for n, k in zip(named, keys)])
    counted = StructType([StructField("_state_rows", LongType())] if keys else [])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[pa.Table, pa.Table, int]] = {}
        for batch in batches:
            table = shape.given([batch])
            for key, rows in _by_key(table, keys):
                mark, count = repr(key.to_pylist()).encode(), rows.num_rows
                made = plugin.partial(rows, params)
                if mark in held:
                    made = plugin.merge(pa.concat_tables([held[mark][1], made]), params)
                    count += held[mark][2]
                held[mark] = key, made, count
            if len(held) > HELD_STATES:
                yield from _joined(held.values(), named)
                held = {}
        yield from _joined(held.values(), named)

    def merged(table: pa.Table) -> pa.Table:
        made = plugin.merge(table.drop_columns([*named, "_state_rows"]), params).append_column(
            "_state_rows", pa.array([pc.sum(table["_state_rows"]).as_py()], pa.int64()))
        for i, n in enumerate(named):
            made = made.add_column(i, n, table.column(n).slice(0, 1))
        return made

    whole: list[pa.Table] = []

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _cut(batches, chunk_rows):
            table = pa.Table.from_batches(piece)
            for one in whole:
                repeated = one.take(pa.array(np.zeros(table.num_rows, np.int64)))
                for n in one.column_names:
                    table = table.append_column(n, repeated.column(n))
            yield from shape.conform(name, plugin.finish(table, params)).to_batches()

    partial = df.mapInArrow(states, StructType(keyed.fields + state.fields + counted.fields))
    if keys:
        found = partial.groupBy(*named).applyInArrow(merged, partial.schema)
        ready = _with_states(df, found, keys, named)
    else:
        # One state for each task, one for each run of neighbouring tasks, then one in all.
        def merged_run(table: pa.Table) -> pa.Table:
            return plugin.merge(table.drop_columns(["_run"]), params)

        runs = partial.withColumn("_run", F.floor(F.spark_partition_id() / MERGED_STATES))
        rows = runs.groupBy("_run").applyInArrow(merged_run, state).toArrow()
        one = plugin.merge(rows if rows.num_rows else plugin.partial(empty, params), params)
        # It travels with the task, so it may be of any type.
        whole.append(one.slice(0, 1).cast(to_arrow_schema(state)))
        ready = df
    return ready.mapInArrow(finish, shape.spark_schema)


def _with_states(df, found, keys, named) -> DataFrame:
    """Rows beside the state of their group.

    States are written first, so the planner knows whether they are small and broadcasts
    them: rows stay where they are. Many or large states are exchanged, and then rows of a
    group with more than ``GROUP_ROWS`` are dealt out to copies of its state.
    """
    if "void" not in found.schema.simpleString():
        # Names of states may be no names of a file's columns. A column without a type is not written at all.
        plain = [f"_state{i}" for i in range(len(found.columns) - len(named) - 1)]
        found = cut_lineage(found.toDF(*named, *plain, "_state_rows")).toDF(*found.columns)
    parts = F.ceil(F.col("_state_rows") / GROUP_ROWS)
    hot = found.where(parts > 1).select(*[F.col(n).alias(f"_hot{n}") for n in named], parts.alias("_parts"))

    def same(others):
        return reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, others)])

    if hot.isEmpty():
        found, own = found.drop("_state_rows"), same(named)
    else:
        # At most one entry for each GROUP_ROWS rows.
        marks = [f"_hot{n}" for n in named]
        salt = F.pmod(F.monotonically_increasing_id(), F.coalesce(F.col("_parts"), F.lit(1)))
        df = df.join(F.broadcast(hot), same(marks), "left").withColumn("_salt", salt).drop(*marks, "_parts")
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1))
        found = found.withColumn("_copy", copies).drop("_state_rows")
        own = same(named) & (F.col("_salt") == F.col("_copy"))
    return df.join(found, own, "left").drop(*named, "_salt", "_copy")


def _by_key(table: pa.Table, keys) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The key (one row) and rows of every group; nulls and NaNs are keys like others."""
    if not keys:
        yield table.slice(0, 1).select([]), table
        return
    codes = np.zeros(table.num_rows, np.int64)
    for k in keys:
        column = table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        codes = np.unique(codes * (column.max(initial=0) + 1) + column, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    table = table.take(pa.array(order))
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for start, end in zip(starts, [*starts[1:], table.num_rows]):
        yield table.slice(start, 1).select(keys), table.slice(start, end - start)


def _joined(held, named) -> Iterator[pa.RecordBatch]:
    for key, state, count in held:
        for i, n in enumerate(named):
            state = state.add_column(i, n, key.column(i))
        if named:
            state = state.append_column("_state_rows", pa.array([count], pa.int64()))
        yield from state.to_batches()
