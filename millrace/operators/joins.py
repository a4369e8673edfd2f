"""Join steps: prefixes, clash renaming and shapes a hot key cannot stall.

The adaptive planner splits a hot key on both sides of an inner join, but only on
the preserved side of a left or right join and on neither side of a full join. The
other sides are handled here, for joins on key equality:

* a right side measured small is broadcast, whatever the join type;
* otherwise the hot keys of a side that would not be split are found by a count over
  its key columns, their rows are dealt out over salts, and the rows of the other
  side are repeated once per salt. A hot key is known to occur, so a repeated row
  that finds nothing under its salt has its match under another and is dropped;
* with further conditions beside the equalities a repeated row may have no match at
  all. Then, where a hot key was found, rows are numbered, joined as an inner join, and
  those whose number did not come out are added.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from millrace.session import cut_lineage

_QUOTED_OR_PREFIX = re.compile(r"('(?:[^']|'')*'|`[^`]*`|\"[^\"]*\")|\b(left|right)\.", re.I)
# A key with fewer rows than this is no burden for one task.
HOT_ROWS = 4_000_000
NULL_KEY_SALTS = 1024

_NAME = r"(left|right)\.(\w+|`(?:[^`]|``)+`)"
_EQUALITY = re.compile(rf"^\s*{_NAME}\s*==?\s*{_NAME}\s*$", re.I)
_WORDS = re.compile(
    r"'(?:[^'\\]|\\.|'')*'|`(?:[^`]|``)*`|\"[^\"]*\"|[()]|(?<!\.)\b(?:and|or|between|case|end)\b", re.I)


def rewrite_prefixes(on: str) -> str:
    """``left.a = right.b`` with the two words turned into table aliases; quoted
    text and longer names such as ``tbl_left.x`` stay as they are."""
    return _QUOTED_OR_PREFIX.sub(lambda m: m[1] or f"{m[2].lower()}_tbl.", on)


class Keys(NamedTuple):
    left: list[str]
    right: list[str]
    # Are there further conditions?
    more: bool


def conjuncts(on: str) -> list[str]:
    """The parts between the outermost ANDs; all in one part when an OR binds them."""
    parts, start, depth, between = [], 0, 0, 0
    for found in _WORDS.finditer(on):
        word = found[0].lower()
        if word in ("(", "case"):
            depth += 1
        elif word in (")", "end"):
            depth -= 1
        elif depth or word not in ("and", "or", "between"):
            continue
        elif word == "or":
            return [on]
        elif word == "between":
            between += 1
        elif between:
            between -= 1
        else:
            parts.append(on[start : found.start()])
            start = found.end()
    return [*parts, on[start:]]


def equality_keys(on: str) -> tuple[list[str], list[str]] | None:
    """Left and right key columns when ``on`` is only ANDed column equalities."""
    keys = condition_keys(on)
    return None if keys is None or keys.more else (keys.left, keys.right)


def condition_keys(on: str) -> Keys | None:
    """Left and right columns of the equalities that ``on`` demands, if any."""
    left, right, parts = [], [], conjuncts(on)
    for match in filter(None, map(_EQUALITY.match, parts)):
        if match[1].lower() != match[3].lower():
            sides = {match[1].lower(): _plain(match[2]), match[3].lower(): _plain(match[4])}
            left.append(sides["left"])
            right.append(sides["right"])
    return Keys(left, right, len(left) < len(parts)) if left else None


def _plain(name: str) -> str:
    return name[1:-1].replace("``", "`") if name.startswith("`") else name


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def clash_names(left: list[str], right: list[str]) -> list[str]:
    """Names for the right columns: a taken name gets ``_1``, ``_2``, ..."""
    used, out = {name.lower() for name in left}, []
    for name in right:
        new, n = name, 0
        while new.lower() in used:
            n += 1
            new = f"{name}_{n}"
        used.add(new.lower())
        out.append(new)
    return out


def join_step(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str,
    *,
    right_is_small: bool = False,
    right_may_be_hot: bool = True,
    skew_safe: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All left columns, then all right columns, clashes renamed.

    ``right_is_small`` says the right side was measured below the broadcast
    threshold, ``right_may_be_hot=False`` that it has no more than ``hot_rows`` rows
    in all. ``skew_safe=False`` leaves everything to the planner.
    """
    names = clash_names(left.columns, right.columns)
    condition = F.expr(rewrite_prefixes(on))
    keys = condition_keys(on)
    plain = how == "inner" or keys is None or not skew_safe or left.isStreaming
    if plain or (how == "left" and (right_is_small or not right_may_be_hot)):
        joined = left.alias("left_tbl").join(right.alias("right_tbl"), condition, how)
        return joined.select(*columns_of("left_tbl", left), *columns_of("right_tbl", right, names))
    if keys.more:
        return _join_numbered(
            left, right, on, how, names, keys, right_is_small, right_may_be_hot, hot_rows)
    if right_is_small:
        return _join_small_right(left, right, on, how, names, keys)
    return _join_salted(left, right, condition, how, names, keys, right_may_be_hot, hot_rows)


_BETWEEN = re.compile(
    r"\b(\w+\.\w+)\s+between\s+(\w+\.\w+)\s+and\s+(\w+\.\w+)", re.I
)
_COMPARISON = re.compile(r"^\s*(left|right)\.(\w+)\s*(<=?|>=?)\s*(left|right)\.(\w+)\s*$", re.I)
_BINNED_TYPES = ("date", "timestamp", "timestamp_ntz", "byte", "short", "integer", "long", "float",
                 "double", "decimal")
# The level of intervals without a finite length: one bin for everything.
_ENDLESS = 99_999


def range_bounds(on: str, left: DataFrame, right: DataFrame) -> tuple[str, str, str, str] | None:
    """``(side, point, low, high)`` when ``on`` holds a column of one side between two
    columns of the other; ``side`` is the point's. A condition with a key equality has
    none: its join is on the key."""
    parts = conjuncts(_BETWEEN.sub(r"\1 >= \2 and \1 <= \3", on))
    lows: dict[tuple, str] = {}
    highs: dict[tuple, str] = {}
    if any(_EQUALITY.match(part) for part in parts):
        return None
    for match in filter(None, map(_COMPARISON.match, parts)):
        one, other = (match[1].lower(), match[2]), (match[4].lower(), match[5])
        if one[0] == other[0]:
            continue
        small, big = (one, other) if match[3].startswith("<") else (other, one)
        lows.setdefault(big, small[1])
        highs.setdefault(small, big[1])
    for (side, point), low in lows.items():
        high = highs.get((side, point))
        if high is None:
            continue
        points, ranges = (left, right) if side == "left" else (right, left)
        types = [frame.schema[name].dataType.typeName() for frame, name in
                 ((points, point), (ranges, low), (ranges, high)) if name in frame.columns]
        times = sum(t.startswith(("date", "timestamp")) for t in types)
        if len(types) == 3 and set(types) <= set(_BINNED_TYPES) and times in (0, 3):
            return side, point, low, high
    return None


def range_join_step(
    left: DataFrame, right: DataFrame, on: str, how: str, point: str, low: str, high: str,
    width=0, side: str = "left",
) -> DataFrame:
    """A join whose condition implies ``low <= point <= high``, without comparing all
    pairs. ``point`` is a column of ``side``, the bounds are columns of the other one.

    Both sides meet in bins. An interval takes bins as wide as the power of two above
    its length (at least ``width``; seconds for times), so it lies in two or three of
    them however long it is, and a point is looked up once in each width that occurs:
    their number follows the logarithm of the lengths. Intervals without an end share
    one bin. A pair meets exactly once; a popular bin is an equality key that the
    adaptive planner splits. Right, full and most left joins write the sides they keep
    to the shared folder first, with a row number, and add the rows that met nobody.
    """
    names = clash_names(left.columns, right.columns)
    if left.isStreaming:
        return join_step(left, right, on, how, skew_safe=False)
    ranges, points = (right, left) if side == "left" else (left, right)
    length = _number(ranges, high) - _number(ranges, low)
    finite = length.isNotNull() & (F.abs(length) < float("inf"))
    least = max(float(width or 0), 2.0**-20)
    level = F.when(finite, F.ceil(F.log2(F.greatest(length, F.lit(least)))).cast("int"))
    level = F.coalesce(level, F.lit(_ENDLESS))
    # Bounds the wrong way round, or missing, match nothing.
    usable = _number(ranges, low) <= _number(ranges, high)
    levels = sorted(r[0] for r in ranges.where(usable).select(level).distinct().collect())
    levels = levels or [_ENDLESS]

    kept = kept_sides(how)
    direct = how == "inner" or (how == side and len(levels) == 1)
    frames = {"left": left, "right": right}
    if not direct:
        frames = _numbered(frames, kept)
    interval_side = "right" if side == "left" else "left"
    binned = dict(frames)
    binned[side] = frames[side].withColumn(
        "_level", F.explode(F.array(*map(F.lit, levels)))
    ).withColumn("_bin", _bin(_number(points, point), F.col("_level")))
    binned[interval_side] = frames[interval_side].where(usable).withColumn("_level", level).withColumn(
        "_bin", F.explode(F.sequence(_bin(_number(ranges, low), F.col("_level")),
                                     _bin(_number(ranges, high), F.col("_level")))))
    condition = F.expr(rewrite_prefixes(on)) & reduce(and_, [
        F.col(f"left_tbl.{c}") == F.col(f"right_tbl.{c}") for c in ("_level", "_bin")])
    met = binned["left"].alias("left_tbl").join(
        binned["right"].alias("right_tbl"), condition, how if direct else "inner")
    if direct:
        return met.select(*columns_of("left_tbl", left), *columns_of("right_tbl", right, names))
    return _with_lone_rows(met, frames, kept, left, right, names)


def kept_sides(how: str) -> tuple[str, ...]:
    return {"inner": (), "full": ("left", "right")}.get(how, (how,))


def _numbered(frames: dict[str, DataFrame], sides: tuple[str, ...]) -> dict[str, DataFrame]:
    """``sides`` written once with a row number, which must not change afterwards."""
    return {name: cut_lineage(side.withColumn(f"_row_{name}", F.monotonically_increasing_id()))
            if name in sides else side for name, side in frames.items()}


def _with_lone_rows(met, frames, sides, left, right, names) -> DataFrame:
    """The pairs of an inner join of numbered ``frames``, and the rows of ``sides``
    whose number is in no pair."""
    joined = met.select(*columns_of("left_tbl", left), *columns_of("right_tbl", right, names))
    for kept in sides:
        number = f"_row_{kept}"
        alone = frames[kept].join(met.select(number).distinct(), number, "left_anti")
        joined = joined.unionByName(lone_rows(alone, kept, left, right, names))
    return joined


def lone_rows(alone, side, left, right, names) -> DataFrame:
    """Rows of one side with the columns of both."""
    if side == "left":
        return alone.select(*map(_named, left.columns), *_nulls(right, names))
    return alone.select(*_nulls(left, left.columns),
                        *[_named(old).alias(new) for old, new in zip(right.columns, names)])


def _number(side: DataFrame, column: str) -> Column:
    value = F.col(f"`{column}`")
    if side.schema[column].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(value.cast(TimestampType())) / 1_000_000
    return value.cast("double")


def _bin(value: Column, level: Column) -> Column:
    return F.when(level == _ENDLESS, F.lit(0).cast("bigint")).otherwise(
        F.floor(value / F.pow(F.lit(2.0), level)))


def needs_left_twice(how: str, on: str, skew_safe: bool = True) -> bool:
    """Does the shape of this join read its left side a second time?"""
    keys = condition_keys(on) if skew_safe else None
    return keys is not None and how in ("right", "full")


def _join_small_right(left, right, on, how, names, keys) -> DataFrame:
    """Right or full join without a shuffle of the left rows: the join that needs no
    unmatched right rows, plus those rows, found by the few keys that did match."""
    left_keys, right_keys, _ = keys
    condition = F.expr(rewrite_prefixes(on))
    matched = join_step(
        left, right, on, "left" if how == "full" else "inner", right_is_small=True
    )
    wanted = right.select(*map(_named, _distinct_names(right_keys))).distinct()
    seen = (
        left.select(*map(_named, _distinct_names(left_keys))).alias("left_tbl")
        .join(wanted.alias("right_tbl"), condition, "left_semi")
        .distinct()
    )
    unmatched = right.alias("right_tbl").join(seen.alias("left_tbl"), condition, "left_anti")
    return matched.unionByName(
        unmatched.select(*_nulls(left, left.columns), *columns_of("right_tbl", right, names))
    )


def _join_numbered(
    left, right, on, how, names, keys, right_is_small, right_may_be_hot, hot_rows
) -> DataFrame:
    """An outer join with further conditions. Without a hot key on a side that is not
    split, or a small right side to broadcast, it is left to the planner."""
    condition = F.expr(rewrite_prefixes(on))
    doubtful = []
    if how in ("left", "full") and right_may_be_hot and not right_is_small:
        doubtful.append((right, keys.right))
    if how in ("right", "full"):
        doubtful.append((left, keys.left))
    hot = right_is_small or any(
        not _counted_hot(side, names_, hot_rows).isEmpty() for side, names_ in doubtful)
    frames = {"left": left, "right": right}
    if not hot:
        joined = left.alias("left_tbl").join(right.alias("right_tbl"), condition, how)
        return joined.select(*columns_of("left_tbl", left), *columns_of("right_tbl", right, names))
    # A broadcast right side finds the lone left rows by itself.
    sides = ("right",) if right_is_small else kept_sides(how)
    frames = _numbered(frames, sides)
    met = frames["left"].alias("left_tbl").join(
        frames["right"].alias("right_tbl"), condition, "left" if how == "full" and right_is_small else "inner")
    return _with_lone_rows(met, frames, sides, left, right, names)


def _join_salted(
    left, right, condition, how, names, keys, right_may_be_hot, hot_rows
) -> DataFrame:
    left_keys, right_keys, _ = keys
    hot_right = hot_left = None
    if how in ("left", "full") and right_may_be_hot:
        hot_right = _hot_keys(right, right_keys, hot_rows, "_hr")
    if how in ("right", "full"):
        hot_left = _hot_keys(left, left_keys, hot_rows, "_hl")
    left_side = _with_salt(left, left_keys, hot_left, "_hl", hot_right, "_hr", first="_hr")
    right_side = _with_salt(right, right_keys, hot_right, "_hr", hot_left, "_hl", first="_hr")
    joined = left_side.alias("left_tbl").join(
        right_side.alias("right_tbl"),
        condition & (F.col("left_tbl._salt") == F.col("right_tbl._salt")),
        how,
    )
    lone_copy = (F.col("left_tbl._repeated") & F.col("right_tbl._salt").isNull()) | (
        F.col("right_tbl._repeated") & F.col("left_tbl._salt").isNull()
    )
    return joined.where(~F.coalesce(lone_copy, F.lit(False))).select(
        *columns_of("left_tbl", left), *columns_of("right_tbl", right, names)
    )


def _hot_keys(side: DataFrame, keys: list[str], hot_rows: int, mark: str) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of salts each needs. There
    are fewer of them than rows / hot_rows, which bounds what is broadcast."""
    hot = _counted_hot(side, keys, hot_rows).select(
        *[_named(k).alias(f"{mark}_{i}") for i, k in enumerate(keys)],
        F.ceil(F.col("_rows") / hot_rows).cast("int").alias(f"{mark}_salts"),
    )
    return F.broadcast(hot)


def _counted_hot(side: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    distinct = list(map(_named, _distinct_names(keys)))
    counted = side.where(reduce(and_, [c.isNotNull() for c in distinct])).groupBy(*distinct).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    return counted.where(F.col("_rows") > hot_rows)


def _with_salt(side, keys, own, own_mark, other, other_mark, first) -> DataFrame:
    """``side`` with ``_salt`` and ``_repeated``. Rows of its own hot keys are spread,
    rows of the other side's hot keys repeated; a key hot on both sides follows the
    mark ``first``. Rows without a key match nothing and are spread as well."""
    for hot, mark in ((own, own_mark), (other, other_mark)):
        if hot is not None:
            same = [_named(k).eqNullSafe(F.col(f"{mark}_{i}")) for i, k in enumerate(keys)]
            side = side.join(hot, reduce(and_, same), "left")
    position = F.monotonically_increasing_id()
    no_key = reduce(or_, [_named(k).isNull() for k in keys])
    spread_by = F.when(no_key, F.lit(NULL_KEY_SALTS))
    repeat_by = F.lit(None).cast("int")
    if own is not None:
        mine = F.col(f"{own_mark}_salts")
        if own_mark != first and other is not None:
            mine = F.when(F.col(f"{other_mark}_salts").isNull(), mine)
        spread_by = F.coalesce(spread_by, mine)
    if other is not None:
        theirs = F.col(f"{other_mark}_salts")
        if other_mark != first and own is not None:
            theirs = F.when(F.col(f"{own_mark}_salts").isNull(), theirs)
        repeat_by = theirs
    spread = F.coalesce(F.pmod(position, spread_by), F.lit(0)).cast("int")
    kept = ["`" + c.replace("`", "``") + "`" for c in side.columns if not c.startswith(("_hr_", "_hl_"))]
    side = side.select(*kept, repeat_by.alias("_repeat_by"), spread.alias("_spread"))
    salts = F.when(
        F.col("_repeat_by").isNotNull(), F.sequence(F.lit(0), F.col("_repeat_by") - 1)
    ).otherwise(F.array("_spread"))
    if other is None:
        return side.select(*kept, F.col("_spread").alias("_salt"), F.lit(False).alias("_repeated"))
    return side.select(
        *kept, F.col("_repeat_by").isNotNull().alias("_repeated"), F.explode(salts).alias("_salt")
    )


def columns_of(alias: str, df: DataFrame, names: list[str] | None = None) -> list[Column]:
    return [
        F.col(f"{alias}.`{old.replace('`', '``')}`").alias(new)
        for old, new in zip(df.columns, names or df.columns)
    ]


def _nulls(df: DataFrame, names: list[str]) -> list[Column]:
    return [
        F.lit(None).cast(field.dataType).alias(name) for field, name in zip(df.schema, names)
    ]


def _distinct_names(keys: list[str]) -> list[str]:
    return list(dict.fromkeys(keys))
