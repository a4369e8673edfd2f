"""Packing: documents as token sequences of a fixed capacity.

Documents are dealt by hash into random groups of a few hundred, and each group is
packed by itself. A document's full sequences stand alone; its remainder is placed by
first-fit decreasing, where a tournament tree over the bins' free room finds the first
bin that fits in logarithmic time. Then the last bins are emptied into the gaps of the
earlier ones, cutting pieces where they overhang, so at most one bin of a group is not
full; that one is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import NAME, encoder

END = 1
PER_GROUP = 512
_PIECES = (
    "{id} {type}, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


class Tournament:
    """Free room of bins in a complete tree whose inner nodes hold the larger child."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.tree = [room] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        node = 1
        while node < self.leaves:
            node *= 2
            if self.tree[node] < need:
                node += 1
        return node - self.leaves

    def take(self, bin_: int, need: int) -> None:
        node = bin_ + self.leaves
        self.tree[node] -= need
        while node > 1:
            node //= 2
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])

    def room(self, bin_: int) -> int:
        return self.tree[bin_ + self.leaves]


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (piece, from, length), as placed, the longest pieces first."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tree, bins = Tournament(max(1, len(lengths)), capacity), []
    for i in order:
        at = tree.first_fit(lengths[i])
        while len(bins) <= at:
            bins.append([])
        bins[at].append((i, 0, lengths[i]))
        tree.take(at, lengths[i])
    return bins


def fill_gaps(bins, capacity: int):
    """All bins full but the last: pieces of the last bins move forward, cut to fit."""
    first, last = 0, len(bins) - 1
    room = [capacity - sum(n for _, _, n in b) for b in bins]
    while first < last:
        if not room[first]:
            first += 1
        elif not bins[last]:
            last -= 1
        else:
            piece, start, n = bins[last].pop()
            moved = min(n, room[first])
            bins[first].append((piece, start, moved))
            room[first] -= moved
            room[last] += n
            if moved < n:
                bins[last].append((piece, start + moved, n - moved))
                room[last] -= n - moved
    return [b for b in bins if b]


def powers_of_two(bin_, capacity: int):
    """One bin as bins whose lengths are powers of two; a full bin as it is."""
    total = sum(n for _, _, n in bin_)
    if total == capacity:
        return [bin_]
    out, rest = [], list(bin_)
    for bit in range(total.bit_length() - 1, -1, -1):
        need, part = total & (1 << bit), []
        while need:
            piece, start, n = rest.pop(0)
            part.append((piece, start, min(n, need)))
            if n > need:
                rest.insert(0, (piece, start + need, n - need))
            need -= min(n, need)
        if part:
            out.append(part)
    return out


def pack(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
         capacity: int = 2048, per_group: int = PER_GROUP, tokenizer: str = NAME,
         seed: int = 11) -> DataFrame:
    """One row per piece of a document: where it starts in the document, its length and
    the checksum of its ids, the sequence it lies in and its offset there.

    A document is its token ids and the end id 1; a null or empty text is the end id
    alone. Rows with a null id are packed like others, repeated rows each by
    themselves; further columns are not read. No rows give no pieces.
    """
    kind = docs.schema[id_column].dataType
    groups = max(1, -(-docs.count() // per_group))
    group = F.pmod(F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column)), F.lit(groups))
    chosen = docs.select(
        group.cast("long").alias("grp"), F.col(id_column).alias("id"),
        F.col(text_column).alias("text"))
    cut = f"grp long, id {kind.simpleString()}, start long, length long, doc_tokens long, ids binary"
    small = chosen.mapInArrow(_tokenise(capacity, tokenizer), cut)
    schema = _PIECES.format(id=id_column, type=kind.simpleString())
    return small.groupBy("grp").applyInArrow(_pack_group(capacity, id_column), schema)


def _tokenise(capacity, tokenizer):
    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            at, start, length, tokens, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                line = np.array(encode.ids(text.as_py()) + [END], "<u4")
                for s in range(0, len(line), capacity):
                    part = line[s : s + capacity]
                    at.append(i)
                    start.append(s)
                    length.append(len(part))
                    tokens.append(len(line))
                    # Of a full sequence only the checksum is needed further on.
                    ids.append(zlib.crc32(part).to_bytes(4, "little")
                               if len(part) == capacity else part.tobytes())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())],
                names=["grp", "id", "start", "length", "doc_tokens", "ids"])

    return run


def _pack_group(capacity, id_name):
    def run(group: pa.Table) -> pa.Table:
        # The same order whichever way the rows arrived.
        group = group.sort_by([("id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        first = int(group.column("grp")[0].as_py()) << 32
        length, start = group.column("length").to_pylist(), group.column("start").to_pylist()
        ids = group.column("ids")
        full = [i for i, n in enumerate(length) if n == capacity]
        rest = [i for i, n in enumerate(length) if n < capacity]
        out = [(i, start[i], capacity, int.from_bytes(ids[i].as_py(), "little"), first + s, 0)
               for s, i in enumerate(full)]
        bins = fill_gaps(first_fit_decreasing([length[i] for i in rest], capacity), capacity)
        sequences = bins[:-1] + (powers_of_two(bins[-1], capacity) if bins else [])
        for s, pieces in enumerate(sequences, first + len(full)):
            offset = 0
            for piece, begin, n in pieces:
                i = rest[piece]
                part = ids[i].as_buffer().slice(4 * begin, 4 * n)
                out.append((i, start[i] + begin, n, zlib.crc32(part), s, offset))
                offset += n
        at, begin, n, crc, sequence, offset = (pa.array(c, pa.int64()) for c in zip(*out))
        return pa.table({
            id_name: group.column("id").take(at), "start": begin, "length": n,
            "ids_crc32": crc, "doc_tokens": group.column("doc_tokens").take(at),
            "sequence_id": sequence, "offset": offset})

    return run
