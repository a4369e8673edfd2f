"""Quantised vectors and their exact inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = np.iinfo(np.int64).max
# Integers below it are exact as floating-point numbers, and so are sums of them.
_EXACT = float(1 << 53)


def quantised(rows: DataFrame, scale: int, id_column: str, vector_column: str, *more: str) -> DataFrame:
    """``id``, the columns ``more``, ``dim`` and ``vector``: floor(scale * x) of every
    component x, as bytes of float64, whatever its size. Null vectors and vectors with a
    null or non-finite component are left out, and those that are not finite once scaled."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            n, first = len(lists), lists.offset
            at = np.frombuffer(lists.buffers()[1], np.int32)[first : first + n + 1].astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[at[0] : at[-1]]
            at = at - at[0]
            with np.errstate(invalid="ignore", over="ignore"):
                values = np.floor(scale * values)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            keep = lists.is_valid().to_numpy(zero_copy_only=False) & (odd[at[1:]] == odd[at[:-1]])
            made = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at * 8), pa.py_buffer(values)])
            dims = pa.array(np.diff(at).astype(np.int32))
            columns = [*batch.columns[1:], dims, made.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    names = ["id", *more, "dim", "vector"]
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in more]
    return rows.select(F.col(vector_column), F.col(id_column).cast("long").alias("id"), *more).mapInArrow(
        run, ", ".join(["id long", *kinds, "dim int", "vector binary"]))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of a binary column as a matrix of float64."""
    if not dim:
        return np.zeros((len(column), 0))
    return np.frombuffer(b"".join(x.as_buffer() for x in column), "<f8").reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers, exactly, as int64;
    those beyond a long are the nearest long."""
    most_a, most_b = (np.abs(x).max(axis=1, initial=0) * (x.shape[1] or 1) ** 0.5 for x in (a, b))
    with np.errstate(over="ignore", invalid="ignore"):
        made = a @ b.T
        if most_a.max(initial=0) * most_b.max(initial=0) < _EXACT:
            return made.astype(np.int64)
        large = most_a[:, None] * most_b[None, :] >= _EXACT
    out = np.where(large, 0, made).astype(np.int64)
    whole = {j: [int(x) for x in b[j]] for j in np.flatnonzero(large.any(axis=0)).tolist()}
    for i in np.flatnonzero(large.any(axis=1)).tolist():
        one = [int(x) for x in a[i]]
        for j in np.flatnonzero(large[i]).tolist():
            out[i, j] = max(-MOST, min(MOST, sum(map(int.__mul__, one, whole[j]))))
    return out
