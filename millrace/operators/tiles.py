"""Joins on any condition, as equality joins on the tiles of a matrix.

Rows of both sides are dealt to slices of a bounded number of rows. A pair of rows meets
in the one tile of their slices, so a left row goes to the tiles of its slice, a right row
to those of its own, and the condition is checked where they meet. A tile is an equality
key: no nested loop, no Cartesian product, and no side has to fit anywhere.

Where the condition demands that an expression of one side is at most one of the other,
slices follow ranges of the two expressions, and tiles whose least value on the one side
is above the greatest on the other are left out; that is half of all for two columns of
like values. A range with many rows has several slices, dealt by position, so a value that
a third of all rows have is spread as well.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from millrace.operators.joins import (
    clash_names, columns_of, conjuncts, kept_sides, lone_rows, rewrite_prefixes,
)
from millrace.session import cut_lineage

# Rows of a slice: a tile compares up to their square.
TILE_ROWS = 20_000
# Ranges of values on each side, and slices at most; beyond, slices hold more rows.
RANGES, SLICES = 64, 4096
# Names of the columns added on the way.
ROW, COLUMN, SLICE, RANGE, KEY, NUMBER = (f"__tile_{n}" for n in ("row", "column", "slice", "range", "key", "number_"))
_NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz")
_TOKENS = re.compile(r"'(?:[^'\\]|\\.|'')*'|`(?:[^`]|``)*`|\"[^\"]*\"|[()]|<=>|<>|!=|<=|>=|=>|->|<|>", re.S)
_SIDE = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|\b(left|right)\s*\.\s*(?=[\w`])", re.I | re.S)


class Bound(NamedTuple):
    """``small`` is at most ``large``; ``side`` is the side of ``small``."""

    side: str
    small: str
    large: str


def bound_of(condition: str) -> Bound | None:
    """The bound that a condition of one comparison sets between expressions of the two
    sides, whichever way it is written."""
    depth, found = 0, None
    for token in _TOKENS.finditer(condition):
        word = token[0]
        if word == "(":
            depth += 1
        elif word == ")":
            depth -= 1
        elif depth == 0 and word[0] in "<>=!-":
            if found or word not in ("<", "<=", ">", ">="):
                return None
            found = token
    if not found:
        return None
    one, other = condition[: found.start()], condition[found.end() :]
    small, large = (one, other) if found[0].startswith("<") else (other, one)
    sides = [{m[1].lower() for m in _SIDE.finditer(text) if m[1]} for text in (small, large)]
    if sides == [{"left"}, {"right"}] or sides == [{"right"}, {"left"}]:
        return Bound(*sides[0], small.strip(), large.strip())
    return None


def _key(frame: DataFrame, expression: str) -> Column | None:
    """An expression of one side as a number that keeps its order; none if it has no such
    type, or cannot be told from the columns alone."""
    plain = _SIDE.sub(lambda m: "" if m[1] else m[0], expression)
    try:
        kind = frame.select(F.expr(plain).alias("x")).schema["x"].dataType
    except AnalysisException:
        return None
    if kind.typeName() not in _NUMBERS:
        return None
    value = F.expr(plain)
    if kind.typeName() in ("date", "timestamp", "timestamp_ntz"):
        value = F.unix_micros(value.cast(TimestampType()))
    # NaN is the greatest number in comparisons.
    return F.nanvl(value.cast("double"), F.lit(float("inf")))


class _Slices(NamedTuple):
    """A side with its range and slice; of each range, its least and greatest value
    and its first and last slice."""

    frame: DataFrame
    least: list[float]
    most: list[float]
    first: list[int]
    last: list[int]


def _sliced(frame: DataFrame, key: Column | None, rows: int) -> _Slices:
    spread = F.xxhash64(F.monotonically_increasing_id())
    if key is None:
        counts, frame = [(0, frame.count(), None, None)], frame.withColumn(RANGE, F.lit(0))
    else:
        frame = frame.withColumn(KEY, key).where(f"{KEY} IS NOT NULL")
        total = frame.count()
        parts = max(1, min(RANGES, -(-total // rows)))
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        edges = frame.agg(F.percentile_approx(KEY, shares, F.lit(10_000))).first()[0] if parts > 1 else []
        edges = sorted(set(edges or []))
        at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(KEY))) if edges else F.lit(0)
        frame = frame.withColumn(RANGE, at)
        counts = sorted(map(tuple, frame.groupBy(RANGE).agg(
            F.count("*"), F.min(KEY), F.max(KEY)).collect()))
        frame = frame.drop(KEY)
    rows = max(rows, -(-sum(c[1] for c in counts) // SLICES))
    place = {number: i for i, (number, *_) in enumerate(counts)}
    parts = [max(1, -(-c[1] // rows)) for c in counts]
    last = [sum(parts[: i + 1]) - 1 for i in range(len(parts))]
    first = [n - p + 1 for n, p in zip(last, parts)]
    # Ranges without rows have no number of their own.
    numbers = F.array(*[F.lit(place.get(i, 0)) for i in range(max(place, default=0) + 1)])
    frame = frame.withColumn(RANGE, F.element_at(numbers, F.col(RANGE) + 1))

    def of_range(values):
        return F.element_at(F.array(*map(F.lit, values)), F.col(RANGE) + 1)

    if counts:
        frame = frame.withColumn(SLICE, (of_range(first) + F.pmod(spread, of_range(parts))).cast("int"))
    else:
        frame = frame.withColumn(SLICE, F.lit(0))
    return _Slices(frame, [c[2] for c in counts], [c[3] for c in counts], first, last)


def _may_meet(small: _Slices, large: _Slices, bounded: bool) -> list[list[int]]:
    """For each range of ``small``, the ranges of ``large`` with values that are not below."""
    every = range(len(large.first))
    if not bounded:
        return [list(every) for _ in small.first]
    # A hair of slack: numbers were rounded to floating point.
    most = [m if abs(m) == float("inf") else m + abs(m) * 1e-12 for m in large.most]
    return [[j for j in every if least <= most[j]] for least in small.least]


def _sent(side: _Slices, partners: list[list[int]], other: _Slices, own: str, across: str) -> DataFrame:
    """Rows with their tiles: the own slice, and one copy for each slice of the partners,
    which lie next to each other."""
    first = [other.first[p[0]] if p else 0 for p in partners] or [0]
    last = [other.last[p[-1]] if p else -1 for p in partners] or [-1]
    start, stop = (F.element_at(F.array(*map(F.lit, v)), F.col(RANGE) + 1) for v in (first, last))
    tiles = F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(tiles, lambda c: F.struct(F.col(SLICE).alias("own"), c.alias("across")))
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in side.frame.drop(RANGE, SLICE).columns]
    return side.frame.select(*kept, F.explode(pairs).alias(RANGE)).select(
        *kept, F.col(f"{RANGE}.own").alias(own), F.col(f"{RANGE}.across").alias(across))


def tiled(left: DataFrame, right: DataFrame, parts: list[str], rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with the row and the column of their tiles: rows that satisfy all ``parts`` of a
    condition meet under exactly one pair of them, other rows under one at most."""
    frames, bound, keys = {"left": left, "right": right}, None, {"left": None, "right": None}
    for bound in filter(None, map(bound_of, parts)):
        other = "right" if bound.side == "left" else "left"
        found = {bound.side: _key(frames[bound.side], bound.small), other: _key(frames[other], bound.large)}
        if all(value is not None for value in found.values()):
            keys = found
            break
    one, two = (_sliced(frames[name], keys[name], rows) for name in ("left", "right"))
    bounded = keys["left"] is not None
    if bounded and bound.side == "right":
        of_right = _may_meet(two, one, True)
        of_left = [[j for j, p in enumerate(of_right) if i in p] for i in range(len(one.first))]
    else:
        of_left = _may_meet(one, two, bounded)
        of_right = [[i for i, p in enumerate(of_left) if j in p] for j in range(len(two.first))]
    return _sent(one, of_left, two, ROW, COLUMN), _sent(two, of_right, one, COLUMN, ROW)


def theta_join_step(left: DataFrame, right: DataFrame, on: str, how: str, rows: int = TILE_ROWS) -> DataFrame:
    """Like :func:`millrace.operators.joins.join_step`, for conditions without a key equality.

    Both sides are read several times, so they are written to the shared folder first. Rows
    of an outer join that meet nobody are those without a match in any of their tiles.
    """
    names, kept = clash_names(left.columns, right.columns), kept_sides(how)
    frames = {name: cut_lineage(side.withColumn(f"{NUMBER}{name}", F.monotonically_increasing_id()))
              for name, side in (("left", left), ("right", right))}
    sides = dict(zip(frames, tiled(frames["left"], frames["right"], conjuncts(on), rows)))
    # Tiles are as small as they are meant to be; a broadcast would be a nested loop again.
    one, two = (sides[name].alias(f"{name}_tbl").hint("merge") for name in ("left", "right"))
    condition = F.expr(rewrite_prefixes(on)) & (F.col(f"left_tbl.{ROW}") == F.col(f"right_tbl.{ROW}")) & (
        F.col(f"left_tbl.{COLUMN}") == F.col(f"right_tbl.{COLUMN}"))
    joined = one.join(two, condition, "inner").select(*columns_of("left_tbl", left), *columns_of("right_tbl", right, names))
    for side in kept:
        number, other = f"{NUMBER}{side}", two if side == "left" else one
        matched = (one if side == "left" else two).join(other, condition, "left_semi").select(number).distinct()
        alone = frames[side].join(matched, number, "left_anti")
        joined = joined.unionByName(lone_rows(alone, side, left, right, names))
    return joined
