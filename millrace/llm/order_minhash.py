"""Document fingerprints by Order MinHash.

The elements of a document are its k-mers of units, numbered by occurrence, so a
repeated k-mer is a new element each time. A unit is a word, or a piece of five bytes
of a longer word. For each of ``sketches`` hash functions the two minimal elements are
taken, put back in text order, and hashed as a tuple. Two texts agree in a sketch when
they share those elements in the same order, so, unlike for sets, moving text around
lowers the likeness, as it raises the edit distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesops import ByteHash, mix, spans, stream, words
from millrace.llm.common import Ranges, pieces, range_bounds

SKETCHES = 64
UNITS = 2
_PIECE = 5
_RANGE_BYTES = 6 << 20
_SLICE_BYTES = 1_000_000


def _units(column):
    """Hashes of the units of all rows, and the row of each."""
    data, offsets = spans(column)
    starts, ends, row = words(data, offsets)
    count = -(-(ends - starts) // _PIECE)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    part = np.arange(int(count.sum())) - np.repeat(first, count)
    begin = np.repeat(starts, count) + part * _PIECE
    end = np.minimum(begin + _PIECE, np.repeat(ends, count))
    return ByteHash(21).ranges(data, begin, end), np.repeat(row, count)


def _elements(column, k: int):
    """Hashes of occurrence-numbered k-mers, by row in text order, and the row of each.
    A text of fewer than k units has one, all its units."""
    units, row = _units(column)
    rows = len(column)
    size = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    hasher = ByteHash(22)
    grams = hasher.grams(units, k)
    at = np.flatnonzero(row[: len(grams)] == row[len(row) - len(grams) :]) if len(grams) else np.zeros(0, int)
    key, owner = grams[at], row[at]
    for short in range(1, k):
        few = np.flatnonzero(size == short)
        if len(few):
            key = np.concatenate([key, hasher.grams(units, short)[first[few]]])
            owner = np.concatenate([owner, few])
    order = np.argsort(owner, kind="stable")
    key, owner = key[order], owner[order]
    with np.errstate(over="ignore"):
        same = key + mix(owner.astype(np.uint64))
        order = np.argsort(same, kind="stable")
        begin = np.concatenate([[True], same[order][1:] != same[order][:-1]]) if len(same) else same > 0
        start = np.flatnonzero(begin)
        number = np.empty(len(same), np.uint64)
        number[order] = np.arange(len(same)) - np.repeat(start, np.diff(np.concatenate([start, [len(same)]])))
        return mix(key + number * np.uint64(0x9E3779B97F4A7C15)), owner


def signatures(column, sketches: int = SKETCHES, k: int = UNITS) -> np.ndarray:
    """One row of 16-bit values for each text; texts without words have zeros, others
    no zero."""
    key, owner = _elements(column, k)
    out = np.zeros((len(column), sketches), np.uint16)
    if not len(key):
        return out
    has, first, count = np.unique(owner, return_index=True, return_counts=True)
    group = np.repeat(np.arange(len(has)), count)
    low = (key >> np.uint64(32)).astype(np.uint32)
    turns = stream(23, 2 * sketches)
    top = np.uint32(0xFFFFFFFF)

    def least(values):
        smallest = np.minimum.reduceat(values, first)
        at = np.flatnonzero(values == smallest[group])
        keep = np.concatenate([[True], group[at[1:]] != group[at[:-1]]])
        return at[keep]

    with np.errstate(over="ignore"):
        for j in range(sketches):
            values = (low ^ np.uint32(turns[2 * j] >> np.uint64(32))) * np.uint32(turns[2 * j + 1] >> np.uint64(32) | np.uint64(1))
            one = least(values)
            values[one] = top
            two = least(values)
            # A text of one element pairs it with itself.
            two = np.where(count == 1, one, two)
            pair = key[np.minimum(one, two)] * np.uint64(0xC2B2AE3D27D4EB4F) + key[np.maximum(one, two)]
            out[has, j] = np.maximum(mix(pair + turns[j]) >> np.uint64(48), np.uint64(1))
    return out


def text_of(made: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in made]


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of sketches in which two fingerprints agree."""
    return (one == other).mean(axis=1)


def fingerprint(docs: DataFrame, *, id_column="doc_id", text_column="text", sketches=SKETCHES) -> DataFrame:
    """``id`` and ``fingerprint`` of every row. Null texts have the fingerprint of the
    empty text, zeros; equal texts have equal ones. No rows give no rows."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text_of(signatures(batch.column(1), sketches)))],
                names=["id", "fingerprint"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, fingerprint string")


def compare_with_next(docs: DataFrame, *, id_column="doc_id", text_column="text",
                      sketches: int = SKETCHES, range_bytes: int = _RANGE_BYTES) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next one.

    Next is by descending id, and the first follows the last; a single document follows
    itself. The edited text is the document without its last floor(n / 2) code points,
    followed by as many (or all) first ones of the next document. Ranges of ids are
    sorted apart; each range also gets the first document of the next one.

    Columns: ``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. Null texts count as empty.
    Rows of one id stand in the order of their texts; rows without an id come last, as
    if theirs were the smallest. Ids are integers. No rows give no rows.
    """
    bounds = range_bounds(docs, id_column, pieces(docs, range_bytes))
    ranges = Ranges(bounds)
    chosen = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.col(id_column).isNull().alias("none"))

    def largest(batches):
        best: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = ranges.of(ids)
            for r in np.unique(at):
                best[int(r)] = max(best.get(int(r), -(1 << 63)), int(ids[at == r].max()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())],
            names=["r", "id"])

    # One row for each range.
    heads = {r["r"]: r["id"] for r in chosen.select("id").mapInArrow(largest, "r long, id long")
             .groupBy("r").agg(F.max("id").alias("id")).collect()}
    falling = sorted(heads, reverse=True)
    # The head of a range is also shown to the range before it, that of the first to the last.
    shown = {heads[r]: falling[i - 1] for i, r in enumerate(falling)}

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = ranges.of(ids)
            copy = np.flatnonzero(np.isin(ids, list(shown)))
            take = pa.array(np.concatenate([np.arange(len(ids)), copy]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([at, [shown[int(i)] for i in ids[copy]]]).astype(np.int64)),
                 pa.array(np.arange(len(take)) >= len(ids)),
                 *(c.take(take) for c in batch.columns)], names=["r", "copy", "id", "text", "none"])

    dealt = chosen.mapInArrow(deal, "r long, copy boolean, id long, text string, none boolean")
    ordered = dealt.repartition(max(1, len(ranges)), "r").sortWithinPartitions(
        "r", "copy", F.desc("id"), "text")
    out = ("id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")
    return ordered.mapInArrow(_compare(sketches), out)


def _compare(sketches):
    def runs(texts):
        start, size = 0, 0
        for i, text in enumerate(texts[:-1]):
            size += len(text)
            if size > _SLICE_BYTES:
                yield start, i + 1
                start, size = i + 1, 0
        if start < len(texts) - 1:
            yield start, len(texts) - 1

    def run(batches):
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            # The last row waits for the one after it.
            copies, ids, texts, none = (
                h + batch.column(n).to_pylist() for h, n in zip(held, ("copy", "id", "text", "none")))
            for a, b in runs(texts):
                own = signatures(pa.array(texts[a : b + 1]), sketches)
                size = [len(t) for t in texts[a:b]]
                edited = [t[: n - n // 2] + after[: n // 2]
                          for t, after, n in zip(texts[a:b], texts[a + 1 :], size)]
                changed = signatures(pa.array(edited), sketches)
                keep = np.flatnonzero(~np.array(copies[a:b]))
                columns = [
                    pa.array([None if x else i for i, x in zip(ids[a:b], none[a:b])], pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(text_of(own[:-1])), pa.array(text_of(changed)),
                    pa.array(likeness(own[:-1], changed)), pa.array(likeness(own[:-1], own[1:]))]
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [c.take(take) for c in columns],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                           "near_edited", "near_next"])
            held = copies[-1:], ids[-1:], texts[-1:], none[-1:]

    return run
