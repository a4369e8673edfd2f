"""Removal of repeated word sequences by fixed-block anchors.

A sequence of ``window`` words that occurs in two documents covers, in one of them, a
whole block of the grid of non-overlapping blocks of (window + 1) / 2 words, and the
other document has those words at some position. So:

1. every document's blocks are indexed and every rolling position probes the index.
   Documents are gathered into chunks of neighbouring ids; a chunk names a key once, so
   a passage that everybody repeats weighs no more than one that two chunks share. Keys
   meet in buckets; those of a block in one chunk and a position in another are anchors;
2. each chunk extends its anchors to all windows that contain one. Windows meet in
   buckets again, by 64-bit hashes besides the bucket, and a chunk learns which of them
   start in an earlier chunk; inside a chunk, all windows are compared directly;
3. windows that overlap merge to maximal repeats, which are cut out.

Chunks are ranges of ids, so "an earlier chunk" means "a smaller id". Texts travel
compressed. Numbers of chunks and buckets follow the size of the input, so each one
stays as small as it is when the input grows. A chunk sends one row to each bucket, or
one for each key where there are fewer; larger chunks and buckets make fewer rows.
Rows without an id, and those of an id that many rows have, are dealt to several chunks
of one rank; of two chunks, the one of lower rank is earlier.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.bytesops import ByteHash, slices, spans, words
from millrace.llm.common import MAX_RANGES, Ranges, input_bytes, range_cuts
from millrace.session import cut_lineage

CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
_PARCEL_BYTES = 8 << 20
_LAST = np.iinfo(np.int64).max
ADDED = ("n_words", "n_removed", "removed")
_ADDED = "n_words long, n_removed long, removed array<struct<first: long, last: long>>"
_LOW = np.uint64(0xFFFFFFFF)
# A chunk's number is its rank times this and its place among chunks of the rank.
_RANK = 1 << 20


class _Text:
    """Words of a run of documents: where they are, and hashes of their sequences."""

    def __init__(self, column, window: int):
        self.data, self.offsets = spans(column)
        self.starts, self.ends, self.row = words(self.data, self.offsets)
        docs, n = len(self.offsets) - 1, len(self.row)
        self.first = np.searchsorted(self.row, np.arange(docs + 1))
        self.window, self.block = window, (window + 1) // 2
        self.hashes = ByteHash(1).ranges(self.data, self.starts, self.ends)
        self.place = np.arange(n) - self.first[self.row]

    def grams(self, seed: int, k: int):
        """Positions in whose document k words start, and the hash of those words."""
        made = ByteHash(seed).grams(self.hashes, k)
        at = np.flatnonzero(self.row[: len(made)] == self.row[k - 1 :]) if len(made) else np.zeros(0, int)
        return at, made[at]


def _key(hashes, buckets):
    """A bucket and 32 further bits; together they tell keys apart well enough for
    candidates, whatever the number of buckets."""
    return (hashes >> np.uint64(32)) % np.uint64(buckets), hashes & _LOW


def _bucket(hashes, buckets):
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(buckets)


def _ids(column):
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _probe(text_at, buckets, window):
    """Keys of all rolling positions of a chunk, and which of them are blocks, as one
    row for each bucket."""

    def run(docs: pa.Table) -> pa.Table:
        number = docs.column("chunk")[0].as_py()
        text = _Text(_unpacked(docs.column("blob")).column(text_at), window)
        at, hashes = text.grams(2, text.block)
        bucket, key = _key(hashes, buckets)
        lone = (text.place[at] % text.block != 0).astype(np.uint64)
        both = np.sort(bucket << np.uint64(33) | key << np.uint64(1) | lone)
        # Of equal keys the first is a block if any is.
        both = both[_runs(both >> np.uint64(1))]
        bucket = (both >> np.uint64(33)).astype(np.int64)
        cuts = _runs(bucket)
        key = (both >> np.uint64(1) & _LOW).astype("<u4")
        block = (both & np.uint64(1)) == 0
        ends = [*cuts[1:], len(both)]
        return pa.table({
            "bucket": pa.array(bucket[cuts], pa.int64()),
            "chunk": pa.array(np.full(len(cuts), number), pa.int64()),
            "keys": pa.array([key[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            "blocks": pa.array([np.packbits(block[a:b]).tobytes() for a, b in zip(cuts, ends)], pa.binary())})

    return run


def _lists(column, kind):
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _answer(owner, values, chosen, bucket, kind):
    """Chosen values as one row for each owner."""
    owner, values = owner[chosen], values[chosen]
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    cuts = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else np.zeros(0, int)
    ends = [*cuts[1:], len(owner)]
    return pa.table({
        "bucket": pa.array(np.full(len(cuts), bucket), pa.int64()),
        "chunk": pa.array(owner[cuts], pa.int64()),
        "keys": pa.array([np.unique(values[a:b]).astype(kind).tobytes() for a, b in zip(cuts, ends)],
                         pa.binary())})


def _runs(sorted_values):
    """Where runs of equal values start."""
    if not len(sorted_values):
        return np.zeros(0, int)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def _anchors(rows: pa.Table) -> pa.Table:
    """Keys of a bucket that are a block in one chunk and occur in another."""
    parts = _lists(rows.column("keys"), "<u4")
    sizes = [len(p) for p in parts]
    keys = np.concatenate(parts)
    chunk = np.repeat(rows.column("chunk").to_numpy(), sizes)
    block = np.concatenate([np.unpackbits(b, count=n).astype(bool) for b, n in
                            zip(_lists(rows.column("blocks"), np.uint8), sizes)])
    order = np.argsort(keys, kind="stable")
    keys, chunk, block = keys[order], chunk[order], block[order]
    at = _runs(keys)
    shared = (np.minimum.reduceat(chunk, at) != np.maximum.reduceat(chunk, at)) \
        & np.logical_or.reduceat(block, at)
    chosen = np.repeat(shared, np.diff(np.concatenate([at, [len(keys)]])))
    return _answer(chunk, keys, chosen, rows.column("bucket")[0].as_py(), "<u4")


def _earlier(rows: pa.Table) -> pa.Table:
    """Windows of a bucket that start in a chunk of lower rank as well."""
    parts = _lists(rows.column("keys"), "<u8")
    keys = np.concatenate(parts)
    chunk = np.repeat(rows.column("chunk").to_numpy(), [len(p) for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, chunk = keys[order], chunk[order]
    at = _runs(keys)
    least = np.repeat(np.minimum.reduceat(chunk, at), np.diff(np.concatenate([at, [len(keys)]])))
    return _answer(chunk, keys, least // _RANK < chunk // _RANK, rows.column("bucket")[0].as_py(), "<u8")


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(column) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in column])


class _Chunks:
    """Chunk numbers of ids. ``shared`` tells into how many chunks the rows of an id go,
    ``none`` those of rows without one; which of them depends on the text."""

    def __init__(self, ranges: Ranges, shared: dict[int, int], none: int):
        self.ranges, self.shared, self.none = ranges, shared, none

    def of(self, ids, texts) -> np.ndarray:
        values, absent = _ids(ids), ids.is_null().to_numpy(zero_copy_only=False)
        made = self.ranges.of(values) * _RANK
        made[absent] = len(self.ranges) * _RANK
        split = [(absent, self.none), *((~absent & (values == one), n) for one, n in self.shared.items())]
        for mask, n in split:
            for i in np.flatnonzero(mask):
                made[i] += zlib.crc32((texts[int(i)].as_py() or "").encode()) % n
        return made


def _parcel(id_at, text_at, chunks):
    """Documents as compressed parcels, one for each chunk of a batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[text_at], _PARCEL_BYTES):
                chunk = chunks.of(part.column(id_at), part.column(text_at))
                names = np.unique(chunk)
                blobs = [_packed(pa.Table.from_batches([part.take(pa.array(np.flatnonzero(chunk == c)))]))
                         for c in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "blob"])

    return run


_KIND = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])
_OPEN, _DONE, _WINDOWS = "open", "done", "windows"


def _extend(id_at, text_at, buckets, window):
    """Of a chunk's documents and anchors: the windows around anchors, the documents
    they or a repeat inside the chunk may change, and the finished others."""

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _KIND.empty_table()
        number = docs.column("chunk")[0].as_py()
        docs = _unpacked(docs.column("blob"))
        text = _Text(docs.column(text_at), window)
        ids = _ids(docs.column(id_at))
        at, grams = text.grams(3, window)
        local = np.zeros(len(text.row), bool)
        if len(at):
            order = np.argsort(grams, kind="stable")
            run_at = _runs(grams[order])
            owner = ids[text.row[at[order]]]
            least = np.repeat(np.minimum.reduceat(owner, run_at),
                              np.diff(np.concatenate([run_at, [len(order)]])))
            local[at[order[least < owner]]] = True
        near = np.zeros(len(text.row) + 1, np.int64)
        if anchors.num_rows:
            known = np.sort(np.concatenate([
                np.frombuffer(k.as_buffer(), "<u4").astype(np.uint64) | np.uint64(b) << np.uint64(32)
                for b, k in zip(anchors.column("bucket").to_pylist(), anchors.column("keys"))]))
            places, hashes = text.grams(2, text.block)
            bucket, key = _key(hashes, buckets)
            probe = bucket << np.uint64(32) | key
            found = np.minimum(np.searchsorted(known, probe), len(known) - 1)
            near[places[known[found] == probe] + 1] = 1
        sums = np.cumsum(near)
        # A window contains an anchor that starts in its first window - block + 1 words.
        around = sums[np.minimum(at + window - text.block + 1, len(text.row))] > sums[at]
        changed = np.zeros(docs.num_rows, bool)
        changed[text.row[at[around]]] = True
        changed[text.row[np.flatnonzero(local)]] = True
        out = []
        sent = np.unique(grams[around])
        bucket = _bucket(sent, buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(order) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            out.append((_WINDOWS, int(bucket[order[a]]), number, sent[order[a:b]].astype("<u8").tobytes()))
        marks = [np.packbits(local[a:b]).tobytes() for a, b in zip(text.first[:-1], text.first[1:])]
        # The last two columns, known by their place: names of input columns are free.
        docs = docs.append_column("local", pa.array(marks, pa.binary()))
        docs = docs.append_column("words", pa.array(np.diff(text.first), pa.int64()))
        for kind, chosen in ((_OPEN, changed), (_DONE, ~changed)):
            if chosen.any():
                out.append((kind, None, number, _packed(docs.take(pa.array(np.flatnonzero(chosen))))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _KIND.types)], schema=_KIND)

    return run


def _cut(text_at, window):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        docs = _unpacked(docs.column("data"))
        text = _Text(docs.column(text_at), window)
        start = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(
            docs.column(docs.num_columns - 2), np.diff(text.first))]) if docs.num_rows else np.zeros(0, np.uint8)
        start = start.astype(np.int64)
        if flags.num_rows:
            known = np.sort(np.concatenate(_lists(flags.column("keys"), "<u8")))
            at, grams = text.grams(3, window)
            found = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            start[at[known[found] == grams]] = 1
        # Windows never leave their document, so neither do the sums.
        depth = np.zeros(len(start) + window, np.int64)
        depth[: len(start)] += start
        depth[window:] -= start
        gone = (np.cumsum(depth)[: len(start)] > 0).astype(np.int8)
        counts = np.add.reduceat(np.concatenate([gone, [0]]).astype(np.int64), text.first[:-1]) \
            * (np.diff(text.first) > 0)
        texts, cuts = docs.column(text_at).to_pylist(), []
        for i in np.flatnonzero(counts):
            a, b = text.first[i], text.first[i + 1]
            edge = np.diff(np.concatenate([[0], gone[a:b], [0]]))
            firsts, lasts = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            cuts.append((i, firsts, lasts - 1))
            texts[i] = _kept(text, a, b, firsts, lasts)
        spans_of = [None] * docs.num_rows
        for i, firsts, lasts in cuts:
            spans_of[i] = [{"first": f, "last": n} for f, n in zip(firsts.tolist(), lasts.tolist())]
        return _result(docs, text_at, texts, counts, spans_of)

    return run


def _kept(text, a, b, firsts, lasts) -> str:
    """The words outside the cuts; each run of them keeps its own white space, and a run
    after a cut the white space before it."""
    data, parts, at = text.data, [], 0
    for first, last in zip([*firsts, b - a], [*lasts, b - a]):
        if first > at:
            begin = text.starts[a + at] if not parts else text.ends[a + at - 1]
            parts.append(data[begin : text.ends[a + first - 1]].tobytes())
        at = last
    return b"".join(parts).decode()


def _result(docs, text_at, texts, counts, spans_of) -> pa.Table:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    own = docs.num_columns - 2
    out = docs.select(range(own)).set_column(text_at, docs.schema.names[text_at], pa.array(texts, pa.string()))
    return (out.append_column("n_words", docs.column(own + 1))
            .append_column("n_removed", pa.array(counts, pa.int64()))
            .append_column("removed", pa.array([s or [] for s in spans_of], kind)))


def _open_parcels(text_at):
    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                docs = _unpacked([blob])
                n = docs.num_rows
                out = _result(docs, text_at, docs.column(text_at).to_pylist(), [0] * n, [None] * n)
                yield from out.to_batches()

    return run


def cut_repeats(docs: DataFrame, *, window: int = 13, id_column: str = "doc_id",
                text_column: str = "text", chunk_bytes: int = CHUNK_BYTES,
                bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` without the words that repeat an earlier document.

    A word goes when one of the windows of ``window`` words over it also starts in a
    document with a smaller id; windows are judged on the input. Words are runs of
    bytes other than space and \\x09-\\x0D. The text column has what is left; added are
    ``n_words``, ``n_removed`` and ``removed`` (first and last word of each maximal
    repeat); input columns of these names are replaced. All other columns stay.

    Null texts stay null and have no words. A row without an id counts as later than
    all others and as equal to its like. Rows with equal ids never remove each other's
    words. Ids are integers; where one has more rows than a chunk, or there is none, rows
    with other texts go to other chunks.
    """
    docs = docs.drop(*ADDED)
    docs = docs.withColumn(text_column, F.col(text_column).cast("string"))
    id_at, text_at = docs.columns.index(id_column), docs.columns.index(text_column)
    parts = max(1, -(-input_bytes(docs) // chunk_bytes))
    buckets = max(1, -(-input_bytes(docs) // bucket_bytes))
    cuts, each = range_cuts(docs, id_column, parts), -(-parts // MAX_RANGES)
    # An id that is several cuts gets a range of its own, and that many chunks of it.
    shared = {one: (n + 1) * each for one, n in Counter(cuts).items() if n > 1}
    ranges = Ranges(sorted({*cuts, *(one + 1 for one in shared if one < _LAST)}), each)
    parcels = docs.mapInArrow(_parcel(id_at, text_at, _Chunks(ranges, shared, parts)), "chunk long, blob binary")
    probes = parcels.groupBy("chunk").applyInArrow(
        _probe(text_at, buckets, window), "bucket long, chunk long, keys binary, blocks binary")
    anchors = probes.groupBy("bucket").applyInArrow(_anchors, "bucket long, chunk long, keys binary")
    extended = cut_lineage(parcels.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(
        _extend(id_at, text_at, buckets, window), "kind string, bucket long, chunk long, data binary"))
    windows = extended.where(F.col("kind") == _WINDOWS).select("bucket", "chunk", F.col("data").alias("keys"))
    flags = windows.groupBy("bucket").applyInArrow(_earlier, "bucket long, chunk long, keys binary")
    schema = StructType(docs.schema.fields + StructType.fromDDL(_ADDED).fields)
    still = extended.where(F.col("kind") == _OPEN).select("chunk", "data")
    cut = still.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(
        _cut(text_at, window), schema)
    done = extended.where(F.col("kind") == _DONE).select("data").mapInArrow(_open_parcels(text_at), schema)
    return cut.unionByName(done)

