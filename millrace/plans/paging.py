"""Pages at any offset, read from the one range of the sort key that holds them."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, MapType, StringType, VariantType

# Rows that a page's sort may meet before the page starts.
WINDOW_ROWS = 100_000
# Ranges counted by one pass over the sort key.
RANGES = 32


def page_at(
    df: DataFrame, order_by: list[str], offset: int, size: int, *,
    descending: tuple[str, ...] = (), window_rows: int = WINDOW_ROWS, ranges: int = RANGES,
) -> DataFrame:
    """Rows ``[offset, offset + size)`` of ``df`` in the order of some columns.

    While more than ``window_rows`` rows come before the page, the rows before each of a few
    sampled keys are counted in one aggregation, and the search goes on between the two keys
    around the page; then only rows between these are sorted. Nothing but counts and at most
    ``16 * ranges`` sampled keys reaches the driver, and the sample decides only how quickly
    the ranges shrink. Nulls come first, in ``descending`` columns last. Rows that tie follow
    the hash of all their columns, so pages neither overlap nor leave rows out, and a key
    that very many rows share is cut like any other. Each round reads the order columns of
    ``df``: give a table or the result of cheap steps, the same at every reading.
    """
    if offset < 0 or size < 0:
        raise ValueError("offset and size of a page cannot be negative")
    tie = "_tie"
    while tie in df.columns:
        tie += "_"
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    rows = df.withColumn(tie, F.xxhash64(*map(_column, plain)) if plain else F.lit(0))
    keys = [(name, name in descending, rows.schema[name].dataType) for name in [*order_by, tie]]
    order = [F.desc(_tick(name)) if down else F.asc(_tick(name)) for name, down, _ in keys]
    # Counting reads the order columns only, until one of their values fills the range.
    skipped, low, high, active = 0, None, None, keys[:-1]
    while offset - skipped > window_rows:
        within = _between(rows, keys, low, high)
        bounds = [bound for bound in _sampled(within, active, order[:len(active)], ranges) if bound != low]
        before = [skipped + n for n in within.agg(F.lit(0), *[
            F.count_if(_before(active, bound)) for bound in bounds]).first()[1:]]
        # The last key with no more rows before it than the offset, the first at the page's end.
        start = bisect.bisect_right(before, offset) - 1
        end = bisect.bisect_left(before, offset + size)
        narrower = (before[start] if start >= 0 else skipped, bounds[start] if start >= 0 else low,
                    bounds[end] if end < len(bounds) else high)
        if narrower != (skipped, low, high):
            skipped, low, high = narrower
        elif active is keys:
            break
        else:
            active = keys
    page = _between(rows, keys, low, high).orderBy(*order).offset(offset - skipped).limit(size)
    return page.drop(tie)


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _column(name: str) -> Column:
    return F.col(_tick(name))


def _between(rows: DataFrame, keys, low, high) -> DataFrame:
    if low is not None:
        rows = rows.where(~_before(keys, low)).where(_not_past(keys[0], low[0], above=True))
    if high is not None:
        rows = rows.where(_before(keys, high)).where(_not_past(keys[0], high[0], above=False))
    return rows


def _sampled(within: DataFrame, keys, order, ranges: int) -> list[tuple]:
    """Keys that cut the rows into about equal parts, in order, as texts."""
    sample = within.select([_tick(name) for name, _, _ in keys]).orderBy(F.rand(7)).limit(16 * ranges)
    texts = [_as_text(_column(name), kind).alias(f"k{i}") for i, (name, _, kind) in enumerate(keys)]
    found = [tuple(row) for row in sample.orderBy(*order).select(texts).collect()]
    step = max(1, len(found) // ranges)
    return list(dict.fromkeys(found[step // 2::step]))


def _as_text(column: Column, kind) -> Column:
    """A value's text that casts back to the same value."""
    return column if isinstance(kind, (StringType, BinaryType)) else column.cast("string")


def _value(text, kind) -> Column:
    return F.lit(text) if isinstance(kind, (StringType, BinaryType)) else F.lit(text).cast(kind)


def _before(keys, bound) -> Column:
    """Whether a row comes before a key; never null."""
    earlier, same = F.lit(False), F.lit(True)
    for (name, down, kind), text in zip(keys[:len(bound)], bound, strict=True):
        column, value = _column(name), _value(text, kind)
        if text is None:
            smaller = column.isNotNull() if down else F.lit(False)
        elif down:
            smaller = F.coalesce(column > value, F.lit(False))
        else:
            smaller = F.coalesce(column < value, F.lit(True))
        earlier, same = earlier | (same & smaller), same & column.eqNullSafe(value)
    return earlier


def _not_past(key, text, above: bool) -> Column:
    """What a bound says of the first column alone, in a form that scans can use."""
    name, down, kind = key
    if text is None:
        return F.lit(True)
    column, value = _column(name), _value(text, kind)
    if above != down:
        plain = column >= value
    else:
        plain = column <= value
    # The end where nulls stand: first of ascending, last of descending columns.
    return plain if above != down else plain | column.isNull()
