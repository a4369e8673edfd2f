"""Hard negatives by exact search in an inverted multi-index.

Vectors are cut in halves. Each half has a codebook of its own, fitted on a bounded
sample; a row lies in the cell of its two nearest codewords. A cell knows how far its rows
are from the codewords, in each half. For a query with halves q1, q2 a half-score of any
row of codeword c is at most q1.c + |q1| r, so a cell's scores are bounded by the sum of
two numbers, and the multi-sequence heap names cells in falling order of that sum without
computing them all.

A search has one or more windows of scores, each with a limit of results. It visits cells
in the heap's order and stops when every window is certified: the next sum is below the
window's last result, or below the window itself. Spark does this in two rounds. The first
visits the best cells of each query and yields floors, results that are to be beaten; the
second visits all cells that the floors leave open, and its results are the answer.

Cells lie in shards of a bounded number of rows, neighbours together; a cell with more
rows has several shards. Queries go in blocks; a block sends one row to each shard that
one of its queries has to visit, with those queries only and the cells they visit.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.vectors import MOST, matrix, products, quantised
from millrace.session import cut_lineage

# Rows that the codebooks are fitted on, rows a cell is meant to have, codewords at most.
SAMPLE, PER_CELL, CODEWORDS = 20_000, 256, 256
# Rows of a shard, queries of a block, rows that the first round visits.
SHARD, BLOCK, SEEDS = 1024, 256, 2048
_TURNS, _SLACK = 12, 1e-9


def codebook(points: np.ndarray, size: int, seed: int) -> np.ndarray:
    """At most ``size`` centres of the points, by Lloyd's algorithm."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    if len(distinct) <= size:
        return distinct
    centres = distinct[rng.choice(len(distinct), size, replace=False)]
    for _ in range(_TURNS):
        nearest = nearest_of(points, centres)[0]
        counts = np.bincount(nearest, minlength=size)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_of(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and distance to the nearest centre of each point."""
    if not points.shape[1]:
        return np.zeros(len(points), np.int64), np.zeros(len(points))
    with np.errstate(over="ignore", invalid="ignore"):
        score = points @ centres.T - (centres**2).sum(1) / 2
        nearest = np.nan_to_num(score, nan=-np.inf).argmax(1)
        distance = np.sqrt(((points - centres[nearest]) ** 2).sum(1))
    return nearest, np.nan_to_num(distance, nan=np.inf)


class Index:
    """Codebooks and the directory of cells, as arrays. ``books`` has two matrices for
    each number of components; ``cells`` rows of dim, i, j, rows, two radii."""

    def __init__(self, books: dict[int, tuple[np.ndarray, np.ndarray]], cells: list[tuple]):
        self.dims: dict[int, dict] = {}
        shard = room = 0
        for dim, i, j, rows, one, two in sorted(cells):
            own = self.dims.get(dim)
            if own is None:
                halves = books_of(books, dim)
                own = self.dims[dim] = {"halves": halves, "at": np.full([len(h) for h in halves], -1), "cells": []}
                room = 0
            parts = -(-rows // SHARD)
            if parts > 1 or rows > room:
                first, shard = shard, shard + parts
                room = SHARD - rows if parts == 1 else 0
            else:
                first, room = shard - 1, room - rows
            own["at"][i, j] = len(own["cells"])
            own["cells"].append((i, j, rows, one, two, first, parts))
        for own in self.dims.values():
            i, j, rows, one, two, first, parts = zip(*own["cells"])
            own["i"], own["j"], own["radii"] = np.array(i), np.array(j), (np.array(one), np.array(two))
            own["rows"], own["first"], own["parts"] = np.array(rows), np.array(first), np.array(parts)
            # The radius of a codeword is that of its widest cell.
            own["wide"] = [np.zeros(len(h)) for h in own["halves"]]
            np.maximum.at(own["wide"][0], own["i"], own["radii"][0])
            np.maximum.at(own["wide"][1], own["j"], own["radii"][1])

    def placed(self):
        """Rows of dim, i, j, first shard, number of shards."""
        return [(dim, int(i), int(j), int(first), int(parts)) for dim, own in self.dims.items()
                for i, j, _, _, _, first, parts in own["cells"]]

    def visits(self, query: np.ndarray, windows: list[tuple[int, int, int]], limit: int | None = None):
        """Numbers of the cells to visit, in the heap's order: those that may hold a score
        of a window (low, high, floor) that is not below its floor. With a limit, cells
        until they have that many rows."""
        own = self.dims.get(len(query))
        if own is None:
            return []
        # The ends of a long stand for all that is beyond them.
        windows = [(float("inf") if high >= MOST else high, -float("inf") if floor <= -MOST else floor)
                   for _, high, floor in windows]
        cut, parts, products_ = len(query) // 2, [], []
        with np.errstate(over="ignore", invalid="ignore"):
            for half, centres, wide in zip((query[:cut], query[cut:]), own["halves"], own["wide"]):
                length = float(np.sqrt((half**2).sum()))
                inner = (centres * half).sum(1)
                slack = _SLACK * (length * (np.sqrt((centres**2).sum(1)) + wide)) + 1e-3
                products_.append((inner, length, slack))
                parts.append(np.nan_to_num(inner + length * wide + slack, nan=np.inf))
        orders = [np.argsort(-p, kind="stable") for p in parts]
        one, two = (p[o] for p, o in zip(parts, orders))
        first, second = (o.tolist() for o in orders)
        one, two = one.tolist(), two.tolist()
        heap, out, rows = [(-(one[0] + two[0]), 0, 0)], [], 0
        lowest = min(floor for _, floor in windows)
        while heap:
            bound, a, b = heapq.heappop(heap)
            if -bound < lowest:
                break
            # (a, b) is pushed by (a, b - 1), and (a + 1, 0) by (a, 0): each cell once.
            if b + 1 < len(two):
                heapq.heappush(heap, (-(one[a] + two[b + 1]), a, b + 1))
            if b == 0 and a + 1 < len(one):
                heapq.heappush(heap, (-(one[a + 1] + two[0]), a + 1, 0))
            cell = own["at"][first[a], second[b]]
            if cell < 0:
                continue
            middle = margin = 0.0
            for k, (inner, length, slack) in enumerate(products_):
                code = (first[a], second[b])[k]
                middle += inner[code]
                margin += length * own["radii"][k][cell] + slack[code]
            # A cell's own radii may be smaller than its codewords'.
            if middle + margin < lowest or not any(
                    not middle + margin < floor and not middle - margin > high for high, floor in windows):
                continue
            out.append(int(cell))
            rows += int(own["rows"][cell])
            if limit is not None and rows >= limit:
                break
        return out


def books_of(books, dim):
    """Codebooks of a number of components; where the sample has none, one codeword."""
    return books.get(dim) or tuple(np.zeros((1, n)) for n in (dim // 2, dim - dim // 2))


def fit(sample: list[tuple[int, bytes]], totals: dict[int, int], per_cell=PER_CELL, most=CODEWORDS):
    """Codebooks from sampled (dim, vector); their sizes follow the ``totals`` of rows."""
    books = {}
    for dim in {d for d, _ in sample}:
        points = np.stack([np.frombuffer(v, "<f8") for d, v in sample if d == dim])
        size = int(min(most, max(1, round((totals.get(dim, len(points)) / per_cell) ** 0.5))))
        cut = dim // 2
        books[dim] = (codebook(points[:, :cut], size, 1), codebook(points[:, cut:], size, 2))
    return books


def _assign(books):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            i, j = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32)
            one, two = np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                points = matrix(batch.column("vector").take(pa.array(at)), dim)
                left, right = books_of(books, dim)
                i[at], one[at] = nearest_of(points[:, : dim // 2], left)
                j[at], two[at] = nearest_of(points[:, dim // 2 :], right)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, (i, j, one, two))], names=[*batch.schema.names, "i", "j", "one", "two"])

    return run


_KEPT = "id long, label long, dim int, vector binary, place long"
_LIST = "shard long, dim int, ids binary, labels binary, cells binary, vectors binary"


def _pack(index):
    """The rows of a shard as one row, sorted by cell and id."""

    def run(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        at = index.dims[dim]["at"]
        cells = at[group.column("i").to_numpy(), group.column("j").to_numpy()]
        ids = group.column("id").fill_null(MOST).to_numpy()
        order = np.lexsort((ids, cells))
        vectors = matrix(group.column("vector"), dim)[order]
        one = [group.column("shard")[0].as_py(), dim, ids[order].tobytes(),
               group.column("label").to_numpy()[order].tobytes(), cells[order].astype("<i4").tobytes(), vectors.tobytes()]
        return pa.table([pa.array([x], t) for x, t in zip(one, (
            pa.int64(), pa.int32(), *[pa.binary()] * 4))], names=["shard", "dim", "ids", "labels", "cells", "vectors"])

    return run


_REQUEST = "shard long, asked binary"


def _ask(index, limit):
    """Queries with their windows in; for each shard they have to visit, a row out."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield from block(batch.slice(at, BLOCK))

    def block(batch):
        wanted: dict[int, list] = {}
        for row in batch.to_pylist():
            query = np.frombuffer(row["vector"], "<f8")
            windows = list(zip(row["lows"], row["highs"], row["floors"]))
            found: dict[int, list[int]] = {}
            own = index.dims.get(row["dim"])
            for cell in index.visits(query, windows, limit) if windows else ():
                for part in range(own["parts"][cell]):
                    found.setdefault(int(own["first"][cell]) + part, []).append(cell)
            for shard, cells in found.items():
                wanted.setdefault(shard, []).append({**row, "cells": cells})
        shards, asked, size = [], [], 0
        for shard, rows in wanted.items():
            shards.append(shard)
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pylist(rows, schema=pa.schema(_ASKED))
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            asked.append(sink.getvalue().to_pybytes())
            size += len(asked[-1])
            if size > 8 << 20:
                yield _requests(shards, asked)
                shards, asked, size = [], [], 0
        yield _requests(shards, asked)

    return run


def _requests(shards, asked):
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(asked, pa.binary())],
                                      names=["shard", "asked"])


_LONGS = pa.list_(pa.int64())
_ASKED = [("id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary()), ("lows", _LONGS),
          ("highs", _LONGS), ("floors", _LONGS), ("cells", pa.list_(pa.int32()))]
_FOUND = "query_id long, w int, id long, score long"


def _score(k: int, same_label: bool):
    """Requests beside the shard they ask: the k best of each window."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _found(*best(row))

    def best(row):
        dim = row["dim"]
        ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        cells = np.frombuffer(row["cells"], "<i4")
        vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), dim)
        asked = pa.ipc.open_stream(row["asked"]).read_all()
        queries, names, own = matrix(asked.column("vector"), dim), asked.column("id").to_numpy(), asked.column("label").to_numpy()
        visits: dict[int, list[int]] = {}
        for n, wanted in enumerate(asked.column("cells").to_pylist()):
            for cell in wanted:
                visits.setdefault(cell, []).append(n)
        width = max(map(len, asked.column("floors").to_pylist()))
        # Windows that a query lacks take nothing.
        highs = np.full((len(names), width), -MOST)
        floors = np.full((len(names), width), MOST)
        for n, (high, floor) in enumerate(zip(asked.column("highs").to_pylist(), asked.column("floors").to_pylist())):
            highs[n, : len(high)], floors[n, : len(floor)] = high, floor
        parts = []
        for cell, members in visits.items():
            a, b = np.searchsorted(cells, [cell, cell + 1])
            if a == b:
                continue
            members = np.array(members)
            scores = products(queries[members], vectors[a:b])
            fits = (ids[None, a:b] != names[members, None]) & ((labels[None, a:b] == own[members, None]) == same_label)
            for w in range(width):
                # Nothing is below -MOST, so the least number marks what does not fit.
                good = np.where(fits & (scores <= highs[members, w, None]) & (scores >= floors[members, w, None]),
                                scores, np.iinfo(np.int64).min)
                least = np.partition(good, -k, axis=1)[:, -k] if b - a > k else np.full(len(members), -MOST)
                q, c = np.nonzero(good >= np.maximum(least, -MOST)[:, None])
                parts.append((members[q], np.full(len(q), w), good[q, c], ids[a:b][c]))
        if not parts:
            return [], [], [], []
        query, window, score, found = map(np.concatenate, zip(*parts))
        # Not -score: the least long has no opposite.
        order = np.lexsort((found, ~score, window, query))
        query, window, score, found = query[order], window[order], score[order], found[order]
        new = np.concatenate([[True], (np.diff(query) != 0) | (np.diff(window) != 0)])[: len(query)]
        begin = np.flatnonzero(new)
        rank = np.arange(len(query)) - begin[np.cumsum(new) - 1] if len(query) else query
        top = rank < k
        return names[query[top]], window[top], found[top], score[top]

    return run


def _found(query, window, found, score):
    found = np.asarray(found, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(query, np.int64)), pa.array(np.asarray(window, np.int32)),
         pa.array(found, mask=found == MOST), pa.array(np.asarray(score, np.int64))],
        names=["query_id", "w", "id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class MultiIndex:
    """The index over all rows of :func:`millrace.llm.vectors.quantised` with a label."""

    def __init__(self, rows: DataFrame, *, sample=SAMPLE, per_cell=PER_CELL, codewords=CODEWORDS):
        rows = cut_lineage(rows.withColumn("place", F.monotonically_increasing_id()))
        # As many rows as there are different numbers of components.
        totals = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
        share = min(1.0, sample / max(1, sum(totals.values())))
        drawn = rows.sample(share, 7).limit(sample).select("dim", "vector").collect()
        books = fit([tuple(r) for r in drawn], totals, per_cell, codewords)
        placed = cut_lineage(rows.select("id", "label", "dim", "vector", "place").mapInArrow(
            _assign(books), f"{_KEPT}, i int, j int, one double, two double"))
        # At most codewords * codewords rows for each number of components.
        cells = placed.groupBy("dim", "i", "j").agg(
            F.count("*"), F.max("one"), F.max("two")).collect()
        self.index = Index(books, [tuple(c) for c in cells])
        self.rows = placed
        where = rows.sparkSession.createDataFrame(
            self.index.placed(), "dim int, i int, j int, first long, parts long")
        dealt = placed.join(where, ["dim", "i", "j"]).withColumn("shard", F.expr("first + place % parts"))
        self.shards = cut_lineage(dealt.select("shard", "dim", "i", "j", "id", "label", "vector").groupBy(
            "shard").applyInArrow(_pack(self.index), _LIST))

    def visit(self, queries: DataFrame, k: int, same_label: bool, limit: int | None) -> DataFrame:
        # Requests are far larger than the queries, which the planner cannot know.
        asked = queries.mapInArrow(_ask(self.index, limit), _REQUEST).hint("merge")
        return _ranked(asked.join(self.shards.hint("merge"), "shard").select(
            "dim", "ids", "labels", "cells", "vectors", "asked").mapInArrow(_score(k, same_label), _FOUND), k)

    def search(self, queries: DataFrame, k: int, same_label: bool, seeds: int = SEEDS) -> DataFrame:
        """``query_id``, ``w``, ``id``, ``score``, ``rank``: of each query and window, the k
        highest scores of rows of its label, or of the others. Queries have ``id, label,
        dim, vector, lows, highs``; the last two are arrays."""
        asked = queries.select("*", F.col("lows").alias("floors"))
        first = self.visit(asked, k, same_label, seeds)
        floors = first.groupBy("query_id", "w").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(
            F.col("n") == k).groupBy("query_id").agg(
            F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("known"))
        known = queries.join(floors, queries.id == floors.query_id, "left").select(
            *queries.columns, F.expr("transform(lows, (low, w) -> coalesce(known[w], low))").alias("floors"))
        return self.visit(cut_lineage(known), k, same_label, None)


def hard_negatives(rows: DataFrame, *, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50,
                   high: int = 95, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding",
                   label_column: str = "label", **index) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``.

    Anchors are the rows whose id is divisible by ``every``; their positives are the
    ``positives`` highest-scoring rows of the same label with another id, and a positive's
    negatives the ``negatives`` highest-scoring rows of other labels whose score is between
    ``low`` and ``high`` percent of the positive's. Ties go to the smaller id; rows without
    an id come last and are no anchors. A score is the inner product of the vectors with
    floor(scale * x) for x, exact; scores beyond a long count as the nearest long.

    Rows with a null label, a null vector or a component that is null or not finite take no
    part. Only vectors with the same number of components meet. Of rows that repeat an
    anchor's id, the least (by number of components, label and bytes) is the anchor;
    repeated candidates are all candidates. Labels are integers. Further columns are not
    read. No rows give no rows.
    """
    usable = quantised(
        rows.where(F.col(label_column).isNotNull()).select(
            F.col(id_column).alias("vec_id"), F.col(label_column).cast("long").alias("label"),
            F.col(vector_column).alias("v")), scale, "vec_id", "v", "label")
    found = MultiIndex(usable, **index)
    own = F.struct("dim", "label", "vector", "i", "j")
    anchors = found.rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(own).alias("x")).select("id", "x.*")
    # Neighbours ask the same shards, so they lie in one block.
    anchors = cut_lineage(anchors.orderBy("dim", "i", "j", "id").drop("i", "j"))
    all_scores = (F.array(F.lit(-MOST).cast("long")).alias("lows"), F.array(F.lit(MOST).cast("long")).alias("highs"))
    best = cut_lineage(found.search(anchors.select("*", *all_scores), positives, True).select(
        F.col("query_id").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # A window for each different score of a positive; below zero there is none.
    scores = best.where("positive_score >= 0").groupBy("anchor_id").agg(
        F.sort_array(F.collect_set("positive_score")).alias("scores"))
    part = "CAST((CAST(p AS DECIMAL(20, 0)) * CAST({} AS DECIMAL(6, 0)) + {}) DIV CAST(100 AS DECIMAL(3, 0)) AS BIGINT)"
    asked = cut_lineage(anchors.join(scores, anchors.id == scores.anchor_id).select(
        anchors.columns + [F.expr(f"transform(scores, p -> {part.format(low, 99)})").alias("lows"),
                           F.expr(f"transform(scores, p -> {part.format(high, 0)})").alias("highs"), "scores"]))
    other = found.search(asked.drop("scores"), negatives, False).select(
        F.col("query_id").alias("anchor_id"), "w", "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    windows = asked.select(F.col("id").alias("anchor_id"), F.posexplode("scores").alias("w", "positive_score"))
    return best.join(windows, ["anchor_id", "positive_score"]).join(other, ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
