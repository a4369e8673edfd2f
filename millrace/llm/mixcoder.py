"""Token ids in files, by an adaptive context-mixing range coder.

A block of ids is coded by itself: its model starts empty, and its payload has a
checksum. The model has three predictions of the next id:

* order 2: what followed the last two ids the last time, and how often in a row it did;
* order 1: the same for the last id alone;
* order 0: the frequencies of the ids seen so far in the block, every id possible.

Their probabilities are mixed with weights that are learned as well, for each pair of
confidences by itself: P(id) = w2 [id = order 2] + w1 [id = order 1] + w0 P0(id). The
bounds of an id's interval follow from the mixture directly, so a range coder spends
-log2 P(id) bits on it. All numbers are integers; writer and reader do the same sums.

A block is cut into lanes, each with a range coder of its own, which share the model:
all lanes take one step, then the model learns from all of them. Steps are array
operations over the lanes; there is no loop over ids.

File format, all numbers little-endian. A file is a run of blocks, each ended by a line
feed. A block is ``MRZ1``, then unsigned 32-bit: length of what follows up to the line
feed, ids, lanes, rows of the document table, bytes of that table, CRC-32 of the ids (as
unsigned 32-bit numbers), CRC-32 of the document table and the payload; unsigned 64-bit:
the number of the file. Then the document table (per document: id, ids in this block, and
flags: 1 the document begins here, 2 it ends here, 4 it has no id; as three arrays of
int64, int64, uint8) and the payload: words of each lane as unsigned 32-bit counts, then
the words of all lanes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import input_bytes
from millrace.llm.tokens import NAME, encoder
from millrace.session import cut_lineage

END = 0
# Ids of a block, and steps that a lane has at least; both are stored with the block.
BLOCK, STEPS = 1 << 21, 256
LANES = 4096
# Text that one file is to hold.
FILE_BYTES = 16 << 20
MAGIC = b"MRZ1"
_HEAD = "<4sIIIIIIIQ"
_VOCABULARY = 1 << 16

# Totals of order 0 and of the mixture. Rounds between two updates of order 0.
_BITS0, _BITS, _REFRESH = 18, 26, 16
_WEIGHTS = 1 << (_BITS - _BITS0)
_SLOTS = 18
_TOP, _LEAST = np.uint64(1 << 32), np.uint64(1 << 30)
_SHIFT, _WORD = np.uint64(_BITS), np.uint64(32)
_IDS = np.arange(_VOCABULARY, dtype=np.uint16)


class Model:
    """Predictions for all lanes of a block, and what they learn from a step.

    A slot of ``one`` or ``two`` is an id times 8 plus a confidence of 0 to 7.
    """

    def __init__(self, lanes: int):
        self.one = np.zeros(_VOCABULARY, np.int32)
        self.two = np.zeros(1 << _SLOTS, np.int32)
        self.before = np.zeros(lanes, np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.seen = np.zeros(_VOCABULARY, np.int64)
        self.fresh: list[np.ndarray] = []
        # Hits of no order, of order 1, of order 2, by the two confidences and whether
        # both orders say the same.
        hits = np.ones((2, 8, 8, 3), np.int64)
        sure = np.arange(8)
        hits[0, :, :, 2] += sure[:, None]
        hits[0, :, :, 1] += sure[None, :]
        hits[1, :, :, 2] += sure[:, None] + sure[None, :]
        hits[:, 0, 0, 0] += 30
        self.hits = hits.reshape(128, 3)
        self._weigh()
        self._rank()

    def _rank(self):
        """Order 0: every id has one share, the rest goes by what was seen."""
        if self.fresh:
            self.seen += np.bincount(np.concatenate(self.fresh), minlength=_VOCABULARY)
            self.fresh = []
        total = int(self.seen.sum())
        shares = np.ones(_VOCABULARY, np.int64)
        if total:
            shares += self.seen * ((1 << _BITS0) - _VOCABULARY) // total
        # What rounding leaves belongs to the last id.
        shares[-1] += (1 << _BITS0) - int(shares.sum())
        until = np.cumsum(shares)
        self.share, self.since = shares.astype(np.int32), (until - shares).astype(np.int32)
        self._owner = None

    def owner(self):
        """The id of each unit of order 0, for readers."""
        if self._owner is None:
            self._owner = np.repeat(_IDS, self.share)
        return self._owner

    def _weigh(self):
        total = self.hits.sum(axis=1)
        free = _WEIGHTS - 3
        self.two_weight = (self.hits[:, 2] * free // total + 1).astype(np.int32)
        self.one_weight = (self.hits[:, 1] * free // total + 1).astype(np.int32)

    def predict(self):
        self.at = ((self.last * 0x9E3779B1 + self.before * 0x85EBCA77) >> 11) & ((1 << _SLOTS) - 1)
        self.slot2, self.slot1 = self.two.take(self.at, mode="clip"), self.one.take(self.last, mode="clip")
        self.id2, self.id1 = self.slot2 >> 3, self.slot1 >> 3
        self.sure2, self.sure1 = self.slot2 & 7, self.slot1 & 7
        self.context = ((self.id2 == self.id1) * np.int32(64) + self.sure2 * np.int32(8) + self.sure1).astype(np.int64)
        two, one = self.two_weight.take(self.context, mode="clip"), self.one_weight.take(self.context, mode="clip")
        self.rest = np.int32(_WEIGHTS) - two - one
        self.mass2, self.mass1 = two << _BITS0, one << _BITS0

    def interval(self, ids, ids32):
        """Start and size of the ids' intervals."""
        self.is2, self.is1 = ids32 == self.id2, ids32 == self.id1
        low = self.rest * self.since.take(ids, mode="clip")
        low += self.mass2 * (self.id2 < ids32)
        low += self.mass1 * (self.id1 < ids32)
        size = self.rest * self.share.take(ids, mode="clip")
        size += self.mass2 * self.is2
        size += self.mass1 * self.is1
        return low.astype(np.uint64), size.astype(np.uint64)

    def at_point(self, point):
        """The ids whose intervals hold the points."""
        small, large = np.minimum(self.id1, self.id2), np.maximum(self.id1, self.id2)
        both = self.mass1 + self.mass2
        mass = np.where(self.id1 < self.id2, self.mass1, self.mass2)
        # Where the interval of a lifted id begins, and where the next one does.
        begin1 = self.rest * self.since.take(small)
        end1 = begin1 + self.rest * self.share.take(small) + mass
        begin2 = self.rest * self.since.take(large) + mass
        end2 = begin2 + self.rest * self.share.take(large) + both - mass
        same = small == large
        np.copyto(end1, end2, where=same)
        # Points behind a lifted id are moved back by its mass.
        bare = point - mass * (point >= end1) - (both - mass) * (point >= end2)
        found = self.owner().take(bare // self.rest, mode="clip").astype(np.int32)
        np.copyto(found, small, where=(point >= begin1) & (point < end1))
        np.copyto(found, large, where=(point >= begin2) & (point < end2) & ~same)
        return found

    def learn(self, ids, ids32, turn: int):
        fresh = ids32 * np.int32(8) + np.int32(1)
        for table, at, slot, sure, hit in ((self.two, self.at, self.slot2, self.sure2, self.is2),
                                           (self.one, self.last, self.slot1, self.sure1, self.is1)):
            # A hit adds to the confidence, a miss halves it or takes the slot.
            table[at] = np.where(hit, slot + (sure < 7), np.where(sure > 1, slot - sure + (sure >> 1), fresh))
        who = np.where(self.is2, 2, self.is1)
        self.hits += np.bincount(self.context * 3 + who, minlength=384).reshape(128, 3)
        self.before, self.last = self.last, ids
        self.fresh.append(ids)
        if turn < 4 or turn % _REFRESH == 0:
            self._weigh()
            self._rank()


def _lanes(n: int, steps: int = STEPS) -> int:
    return max(1, min(LANES, n // steps))


def encode(ids: np.ndarray) -> tuple[int, bytes]:
    """Lanes and payload of a block of ids below 65,536."""
    n = len(ids)
    lanes = _lanes(n)
    steps = -(-n // lanes) if n else 0
    padded = np.zeros(steps * lanes, np.int32)
    padded[:n] = ids
    # Lane i has the ids from i * steps on; the last ones may be padding.
    columns = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = Model(lanes)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words, owners = [], []
    for turn in range(steps):
        narrow = columns[turn]
        now = narrow.astype(np.int64)
        model.predict()
        start, size = model.interval(now, narrow)
        unit = wide >> _SHIFT
        low += unit * start
        wide = unit * size
        _shift_out(low, wide, words, owners)
        model.learn(now, narrow, turn)
    for _ in range(2):
        words.append((low >> _WORD).astype("<u4"))
        owners.append(np.arange(lanes, dtype=np.uint16))
        low <<= _WORD
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=lanes).astype("<u4")
    return lanes, counts.tobytes() + np.concatenate(words)[order].tobytes()


def _shift_out(low, wide, words, owners):
    """Words that no longer change leave the coders; a range that stays small around a
    change of word is cut."""
    at = np.flatnonzero(((low ^ (low + wide)) < _TOP) | (wide < _LEAST))
    while len(at):
        a, w = low[at], wide[at]
        w = np.where((a ^ (a + w)) < _TOP, w, (~a + np.uint64(1)) & (_LEAST - np.uint64(1)))
        words.append((a >> _WORD).astype("<u4"))
        owners.append(at.astype(np.uint16))
        a, w = a << _WORD, w << _WORD
        low[at], wide[at] = a, w
        at = at[((a ^ (a + w)) < _TOP) | (w < _LEAST)]


def decode(payload, n: int, lanes: int) -> np.ndarray:
    """The ids of a block."""
    steps = -(-n // lanes) if n else 0
    counts = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(payload, "<u4", offset=4 * lanes), np.zeros(1, "<u4")]).astype(np.uint64)
    place = np.cumsum(counts) - counts
    if int(counts.sum()) != len(words) - 1:
        raise ValueError("a block's payload has the wrong length")
    code = words[place] << _WORD | words[place + 1]
    place += 2
    model = Model(lanes)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out = np.empty((steps, lanes), "<u4")
    most = np.uint64((1 << _BITS) - 1)
    for turn in range(steps):
        model.predict()
        unit = wide >> _SHIFT
        narrow = model.at_point(np.minimum((code - low) // unit, most).astype(np.int32))
        now = narrow.astype(np.int64)
        start, size = model.interval(now, narrow)
        low += unit * start
        wide = unit * size
        at = np.flatnonzero(((low ^ (low + wide)) < _TOP) | (wide < _LEAST))
        while len(at):
            a, w = low[at], wide[at]
            w = np.where((a ^ (a + w)) < _TOP, w, (~a + np.uint64(1)) & (_LEAST - np.uint64(1)))
            code[at] = code[at] << _WORD | words[place[at]]
            place[at] += 1
            a, w = a << _WORD, w << _WORD
            low[at], wide[at] = a, w
            at = at[((a ^ (a + w)) < _TOP) | (w < _LEAST)]
        out[turn] = now
        model.learn(now, narrow, turn)
    return np.ascontiguousarray(out.T).ravel()[:n]


def block(ids: np.ndarray, table: list[tuple[int | None, int, int]], file: int) -> bytes:
    """A block of the file format, with its line feed."""
    names = np.array([0 if i is None else i for i, _, _ in table], "<i8")
    sizes = np.array([n for _, n, _ in table], "<i8")
    flags = np.array([f | (4 if i is None else 0) for i, _, f in table], np.uint8)
    documents = names.tobytes() + sizes.tobytes() + flags.tobytes()
    lanes, payload = encode(ids)
    body = documents + payload
    head = struct.pack(_HEAD, MAGIC, len(body), len(ids), lanes, len(table), len(documents),
                      zlib.crc32(ids.astype("<u4", copy=False)), zlib.crc32(body), file)
    return b"".join((head, body, b"\n"))


def blocks(data):
    """``file``, document table and ids of each block of a file; a damaged file fails."""
    view, at = memoryview(data), 0
    while at < len(view):
        if len(view) - at < struct.calcsize(_HEAD):
            raise ValueError("a file ends within the head of a block")
        magic, length, n, lanes, rows, size, ids_sum, body_sum, file = struct.unpack_from(_HEAD, view, at)
        body = view[at + struct.calcsize(_HEAD) : at + struct.calcsize(_HEAD) + length]
        at += struct.calcsize(_HEAD) + length + 1
        if magic != MAGIC or len(body) < length or view[at - 1 : at] != b"\n":
            raise ValueError("not a block of token ids, or one that is cut off")
        if zlib.crc32(body) != body_sum:
            raise ValueError("a block differs from its checksum")
        names = np.frombuffer(body, "<i8", rows)
        sizes = np.frombuffer(body, "<i8", rows, 8 * rows)
        flags = np.frombuffer(body, np.uint8, rows, 16 * rows)
        ids = decode(body[size:], n, lanes)
        if zlib.crc32(ids) != ids_sum:
            raise ValueError("the ids of a block differ from their checksum")
        yield file, zip(names.tolist(), sizes.tolist(), flags.tolist()), ids


def _coded(tokenizer: str, per_block: int):
    def run(batches):
        encoder_ = encoder(tokenizer)
        held, table, size, file = [], [], 0, 0

        def made():
            # The writer of lines adds the line feed.
            line = block(np.concatenate(held), table, file)[:-1]
            return pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], names=["value"])

        for batch in batches:
            for part, name, text in zip(*batch.columns):
                file, name = part.as_py(), name.as_py()
                ids = np.append(encoder_.array(text.as_py()), np.uint32(END))
                if ids.max() >= _VOCABULARY:
                    raise ValueError("token ids of 65,536 and more do not fit the format")
                at = 0
                while at < len(ids):
                    now = ids[at : at + per_block - size]
                    table.append((name, len(now), (at == 0) + 2 * (at + len(now) == len(ids))))
                    held.append(now)
                    at, size = at + len(now), size + len(now)
                    if size == per_block:
                        yield made()
                        held, table, size = [], [], 0
        if held:
            yield made()

    return run


def write_ids(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text",
              tokenizer: str = NAME, file_bytes: int = FILE_BYTES, per_block: int = BLOCK) -> None:
    """Write the ids of every text, and the end id, into a new folder of files whose
    numbers and contents follow ascending ids.

    A null text counts as empty. Rows without an id come last. Rows that repeat an id lie
    next to each other, ordered by a hash of their texts. Further columns are not read;
    no rows make no blocks. The files are about ``file_bytes`` of input each, cut by
    ranges of id, text and position, so no id is too frequent for one of them.
    """
    parts = max(1, -(-input_bytes(docs) // file_bytes))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    order = [F.asc_nulls_last("id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    coded = dealt.select(F.spark_partition_id().cast("long").alias("file"), "id", "text").mapInArrow(
        _coded(tokenizer, per_block), "value binary")
    coded.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option(
        "compression", "none").text(path)


_ROWS = "file long, place long, doc_id long, n_tokens long, ids_crc32 long"


def _decoded(with_ids: bool):
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out, place, name, size, check, parts, inside = [], 0, None, 0, 0, [], False
                for file, table, ids in blocks(content.as_buffer()):
                    at = 0
                    for doc, n, flags in table:
                        part, at = ids[at : at + n], at + n
                        if inside == bool(flags & 1):
                            raise ValueError("a document goes on in another file, or lacks its begin")
                        if flags & 1:
                            name, size, check, parts = None if flags & 4 else doc, 0, 0, []
                        size, check, inside = size + n, zlib.crc32(part, check), not flags & 2
                        if with_ids:
                            parts.append(part)
                        if flags & 2:
                            whole = np.concatenate(parts).astype(np.int32) if with_ids else None
                            out.append((file, place, name, size, check, *([whole] if with_ids else [])))
                            place += size
                    yield _as_batch(out, with_ids)
                    out = []
                if inside:
                    raise ValueError("a file ends within a document")

    return run


def _as_batch(out, with_ids):
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
    columns = zip(*out) if out else [[] for _ in kinds]
    names = [c.split()[0] for c in _ROWS.split(", ")] + ["ids"] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def read_ids(spark: SparkSession, path: str, *, ids: bool = False) -> DataFrame:
    """One row per document of the files in a folder: ``file``, ``place`` (ids before it
    in its file), ``doc_id``, ``n_tokens`` (with the end id), ``ids_crc32`` and, if
    wanted, ``ids``. A file whose checksums do not agree, or that is cut off, fails."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(_decoded(ids), _ROWS + (", ids array<int>" if ids else ""))


def with_starts(rows: DataFrame) -> DataFrame:
    """Rows of :func:`read_ids` with ``start``: the ids of all documents before each one.
    Files are summed up in slices of 1,024, then slices, so no task sees all files."""
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn(
        "slice", F.floor(F.col("file") / 1024))
    files = cut_lineage(files)
    before = [Window.unboundedPreceding, -1]
    inside = Window.partitionBy("slice").orderBy("file").rowsBetween(*before)
    slices = files.groupBy("slice").agg(F.sum("n").alias("n")).select(
        "slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(*before)), F.lit(0)).alias("far"))
    near = files.select("file", "slice", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("near"))
    starts = near.join(slices, "slice").select("file", (F.col("near") + F.col("far")).alias("begin"))
    return rows.join(starts, "file").withColumn("start", F.col("begin") + F.col("place")).drop("begin")
