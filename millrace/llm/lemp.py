"""Ranked lexical search over all documents by norm buckets (LEMP).

A document is a vector of impacts, one for each term that some query has; a query counts
its terms; a score is their inner product. Only the queries' terms matter to any product,
so vectors have no others. For lengths both sides are balanced, which leaves products as
they are: a coordinate of weight w is divided by the root of w in documents and multiplied
by it in queries. Queries are taken in blocks of a bounded size, and each block meets all
documents:

1. one pass over the texts writes each document's terms of the block and its length, and
   yields the corpus counts that weights need;
2. the longest vectors of the corpus are searched first. The k-th best score a query has
   there is a floor for its result;
3. every task orders its vectors by length and cuts them into buckets. Against a bucket, a
   query's best possible score is its own length times the bucket's greatest length
   (Cauchy-Schwarz); buckets below the floor are passed over, and so are all behind them.
   Inside a bucket the query's strongest coordinates are summed from the bucket's
   postings, and what the other coordinates can add is again bounded by lengths; only
   documents whose bound reaches the floor are scored, exactly, in integers. Floors rise
   as a task finds better documents.

Bounds are floating-point with slack; scores are 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

K = 20
# Text of the queries that one pass over the documents serves.
QUERY_BYTES = 4 << 20
# Documents of a bucket, and entries of vectors that a task orders at once.
BUCKET, ENTRIES = 1024, 1 << 21
# Share of the documents whose vectors are longest and are searched first.
_FIRST = 0.01
# Share of a query's squared length that its focus coordinates make up.
_FOCUS = 0.9
_SLACK = 1 + 1e-9
_LAST = np.iinfo(np.int64).max

# Fixed values of the score: what a letter or digit is, and the numbers in the formula.
_TERM_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
WEIGHT, UNIT, STEP, FLAT, SLOPE = 1000, 1_000_000_000, 12, 75, 25


def _table() -> bytes:
    lower = bytes(range(256)).lower()
    return bytes(lower[b] if b in _TERM_BYTES else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_table()).split() if text else []


_VECTORS = "doc_id long, n long, terms binary, counts binary"


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_column="doc_id", text_column="text") -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``terms`` (numbers in the vocabulary, as
    int32) and ``counts`` (int64) of every row; a null text has none."""
    table = _table()

    def run(batches):
        for batch in batches:
            sizes, names, counts = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().translate(table).split()
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                sizes.append(len(words))
                names.append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                counts.append(np.fromiter(found.values(), "<i8", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text")).mapInArrow(run, _VECTORS)


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]].tobytes() if data is not None else b""
    values = np.frombuffer(values, kind)
    return values, np.diff(at) // values.itemsize


def document_counts(made: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is; a task adds up its own."""

    def run(batches):
        seen = np.zeros(size, np.int64)
        for batch in batches:
            seen += np.bincount(_flat(batch.column(0), "<i4")[0], minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "docs"])

    counted = made.select("terms").mapInArrow(run, "term long, docs long")
    out = np.zeros(size, np.int64)
    # No more rows than the block's queries have terms.
    for row in counted.groupBy("term").agg(F.sum("docs").alias("docs")).toLocalIterator():
        out[row["term"]] = row["docs"]
    return out


def weights(documents: int, having: np.ndarray) -> np.ndarray:
    return np.floor(WEIGHT * np.log((2 * documents + 2) / (2 * having + 1))).astype(np.int64)


def _gains(counts, m):
    """A term's impact in a document of part ``m``, over its weight."""
    return UNIT * counts // (WEIGHT * counts + STEP * m)


def measured(made: DataFrame, weight: np.ndarray, documents: int, size: int) -> DataFrame:
    """The vectors that have terms, with ``m`` and ``length``; ``documents`` and ``size``
    are the corpus's documents and terms. The product under the division has up to 38 digits."""
    m = F.expr(f"{FLAT} + (CAST({SLOPE} AS DECIMAL(2, 0)) * CAST(n AS DECIMAL(18, 0)) * CAST({documents} AS "
               f"DECIMAL(18, 0))) DIV CAST({max(1, size)} AS DECIMAL(18, 0))").cast("long")

    def run(batches):
        for batch in batches:
            numbers, sizes = _flat(batch.column(2), "<i4")
            counts, _ = _flat(batch.column(3), "<i8")
            row = np.repeat(np.arange(len(sizes)), sizes)
            m = batch.column(1).to_numpy()
            squares = weight[numbers] * _gains(counts, m[row]).astype(float) ** 2
            lengths = np.sqrt(np.bincount(row, squares, minlength=len(sizes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths)],
                                             names=["doc_id", "m", "terms", "counts", "length"])

    return made.where(F.length("terms") > 0).select("doc_id", m.alias("m"), "terms", "counts").mapInArrow(
        run, "doc_id long, m long, terms binary, counts binary, length double")


class _Queries:
    """A block's queries as vectors over the vocabulary, strongest coordinates first."""

    def __init__(self, counted: list[dict[int, int]], weight: np.ndarray):
        self.numbers, self.counts, self.focus, self.rest, self.lengths = [], [], [], [], []
        for found in counted:
            numbers = np.fromiter(found.keys(), np.int64, len(found))
            counts = np.fromiter(found.values(), np.int64, len(found))
            squares = counts.astype(float) ** 2 * weight[numbers]
            order = np.argsort(-squares, kind="stable")
            upto = np.cumsum(squares[order])
            total = float(upto[-1]) if len(upto) else 0.0
            focus = min(len(order), int(np.searchsorted(upto, _FOCUS * total)) + 1)
            self.numbers.append(numbers[order].tolist())
            self.counts.append(counts[order].tolist())
            self.focus.append(focus)
            self.lengths.append(total**0.5)
            self.rest.append(float(squares[order[focus:]].sum()) ** 0.5)


class _Bucket:
    """Documents of similar length and their postings by term."""

    def __init__(self, ids, lengths, row, numbers, gains):
        self.ids, self.lengths, self.squares = ids, lengths, lengths**2
        order = np.argsort(numbers, kind="stable")
        self.row, self.gain, numbers = row[order], gains[order], numbers[order]
        at = np.flatnonzero(np.diff(numbers, prepend=-1)).tolist()
        self.place = dict(zip(numbers[at].tolist(), zip(at, [*at[1:], len(numbers)])))

    def candidates(self, queries, q, weight, floor):
        """Rows and exact scores of the documents that reach ``floor``."""
        numbers, counts, focus = queries.numbers[q], queries.counts[q], queries.focus[q]
        exact, rest = np.zeros(len(self.ids), np.int64), self.squares.copy()

        def add(part, counts, bounded=False):
            for number, count in zip(part, counts):
                a, b = self.place.get(number, (0, 0))
                if a < b:
                    row, gain = self.row[a:b], self.gain[a:b]
                    exact[row] += count * weight[number] * gain
                    if bounded:
                        rest[row] -= weight[number] * gain.astype(float) ** 2

        add(numbers[:focus], counts[:focus], True)
        # Differences of squares are off by the rounding of the squares.
        beyond = np.sqrt(np.maximum(rest, 0) + self.squares * 1e-9) * queries.rest[q]
        near = (exact + beyond) * _SLACK >= floor
        if not near.any():
            return (), ()
        add(numbers[focus:], counts[focus:])
        at = np.flatnonzero(near & (exact >= floor))
        return self.ids[at].tolist(), exact[at].tolist()


def _buckets(parts, weight, size):
    """Vectors, longest first and ties by id, as buckets."""
    ids, m, lengths, sizes, numbers, counts = (np.concatenate(c) for c in zip(*parts))
    begin = np.cumsum(sizes) - sizes
    order = np.lexsort((ids, -lengths))
    for at in np.array_split(order, -(-len(order) // size)):
        row = np.repeat(np.arange(len(at)), sizes[at])
        places = np.arange(len(row)) + np.repeat(begin[at] - (np.cumsum(sizes[at]) - sizes[at]), sizes[at])
        yield _Bucket(ids[at], lengths[at], row, numbers[places], _gains(counts[places], m[at][row]))


def _search(queries, weight, floors, k, bucket):
    def run(batches):
        best: list[list] = [[] for _ in floors]
        floor = list(floors)

        def look(parts):
            going = range(len(floor))
            for b in _buckets(parts, weight, bucket):
                top = float(b.lengths[0]) * _SLACK
                # Buckets only get shorter: a query done with one is done with the rest.
                going = [q for q in going if queries.lengths[q] * top >= floor[q]]
                if not going:
                    break
                for q in going:
                    own = best[q]
                    for name, score in zip(*b.candidates(queries, q, weight, floor[q])):
                        item = (score, -name)
                        if len(own) < k:
                            heapq.heappush(own, item)
                        elif item > own[0]:
                            heapq.heapreplace(own, item)
                    if len(own) == k:
                        floor[q] = max(floor[q], own[0][0])

        parts, held = [], 0
        for batch in batches:
            numbers, sizes = _flat(batch.column(2), "<i4")
            parts.append((batch.column(0).fill_null(_LAST).to_numpy(), batch.column(1).to_numpy(),
                          batch.column(4).to_numpy(), sizes, numbers, _flat(batch.column(3), "<i8")[0]))
            held += len(numbers)
            if held >= ENTRIES:
                look(parts)
                parts, held = [], 0
        if held:
            look(parts)
        out = [(q, None if -name == _LAST else -name, score) for q, own in enumerate(best) for score, name in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], names=["q", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs, items, k, id_column, text_column, item_column, bucket):
    """The results of one block of queries, as rows of (item, text)."""
    spark = docs.sparkSession
    counted = [Counter(terms(text)) for _, text in items]
    vocabulary = {term: i for i, term in enumerate(sorted(set().union(*counted)))}
    made = cut_lineage(vectors(docs, vocabulary, id_column, text_column))
    documents, size = made.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = weights(documents, document_counts(made, len(vocabulary)))
    queries = _Queries([{vocabulary[t]: n for t, n in found.items()} for found in counted], weight)
    rows = measured(made, weight, documents, size)
    kind = "q long, doc_id long, score long"
    edge = rows.agg(F.percentile_approx("length", F.lit(1 - _FIRST), F.lit(1000))).first()[0]
    floors = [1] * len(items)
    first = cut_lineage(_ranked(rows.where(F.col("length") > F.lit(edge)).mapInArrow(
        _search(queries, weight, floors, k, bucket), kind), k))
    # One row for each query of the block.
    for row in first.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).toLocalIterator():
        if row["n"] == k:
            floors[row["q"]] = row["least"]
    rest = rows.where(F.col("length") <= F.lit(edge)).mapInArrow(_search(queries, weight, floors, k, bucket), kind)
    names = spark.createDataFrame(
        [(q, name) for q, (name, _) in enumerate(items)], f"q long, item_id {item_column}")
    return _ranked(first.drop("rank").unionByName(rest), k).join(names, "q").select(
        "item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, *, k: int = K, id_column: str = "doc_id", text_column: str = "text",
           item_column: str = "item_id", query_column: str = "text", query_bytes: int = QUERY_BYTES,
           bucket: int = BUCKET) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` of each query's ``k`` highest
    positive scores; ties go to the smaller id, rows without an id come last.

    Null and empty texts, of documents or queries, have no terms and are in no result, nor
    do such documents count in N. Rows that repeat a document count and are ranked one by
    one. Of query rows with one id the one with the least text counts; a null id is an id.
    Document ids are integers. Further columns are not read. No documents, or no queries,
    give no rows. Every block of queries is a pass over all documents.
    """
    asked = cut_lineage(queries.groupBy(F.col(item_column).alias("item")).agg(
        F.min(F.col(query_column).cast("string")).alias("text")))
    kind = asked.schema["item"].dataType.simpleString()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // query_bytes))
    out = None
    for number in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        items = [(r["item"], r["text"]) for r in mine.orderBy("item").toLocalIterator()]
        found = _block(docs, items, k, id_column, text_column, kind, bucket)
        out = found if out is None else out.unionByName(found)
    return out
