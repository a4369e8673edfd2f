"""Words of whole Arrow string columns and their hashes, without a loop over words.

A column is taken as one byte buffer with document offsets. A word hash is a
polynomial over random byte values, read off running sums, and then mixed; hashes of
k consecutive words are polynomials over word hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_AT_ONCE = 1 << 18
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def mix(x):
    """A bijection of 64-bit values after which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int):
    """n pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed) * _MIX1 + np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN)


def spans(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(data, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each run of bytes other than space and \\x09-\\x0D starts and ends, and the
    index of its row. Words never run over the end of a row."""
    inside = ~_WHITE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class ByteHash:
    """Hashes of byte ranges of a buffer, one function for each seed."""

    def __init__(self, seed: int):
        self.values = stream(seed, 256)
        self.base = stream(seed + 1, 1)[0] | np.uint64(1)
        # The inverse of an odd number modulo 2**64.
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.odd = stream(seed + 2, 1)[0] | np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                for name, base in (("powers", self.base), ("inverses", self.inverse)):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def ranges(self, data, starts, ends) -> np.ndarray:
        """Hashes of rising ranges that do not overlap, taken a few at a time so that
        the running sums stay small, however long the data is."""
        out, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            low = starts[at]
            stop = max(at + 1, int(np.searchsorted(ends, low + _AT_ONCE, side="right")))
            out[at:stop] = self._ranges(
                data[low : ends[stop - 1]], starts[at:stop] - low, ends[at:stop] - low)
            at = stop
        return out

    def _ranges(self, data, starts, ends) -> np.ndarray:
        with np.errstate(over="ignore"):
            self._grow(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def grams(self, hashes, k: int) -> np.ndarray:
        """Hash of each k consecutive values; shorter by k - 1 than the input."""
        n = max(0, len(hashes) - k + 1)
        with np.errstate(over="ignore"):
            total = hashes[:n].copy()
            for j in range(1, k):
                total *= self.odd
                total += hashes[j : j + n]
            return mix(total)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000):
    """The batch in runs of rows of about ``limit`` bytes of text each; a longer text
    is a run by itself."""
    at = batch.schema.get_field_index(column)
    sizes = spans(batch.column(at))[1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
