"""Exact top-k inner products with an M-tree, best first.

Vectors are dealt by hash into blocks of a few thousand, and a block becomes an M-tree:
pages of entries, each a routing vector with the covering radius of what lies below and
the distance to the routing vector of its parent page. The tree is a table, one row per
page. Queries come in blocks as well; a task searches one tree for one block of them.

For a query q, an entry with vector c and radius r bounds what lies below it by
q.c + |q| r, and before q.c is known by q.p + |q| (d(c, p) + r), with p the parent's
vector: the triangle inequality with stored distances. Pages are opened in the order of
their bounds, and an entry whose parent bound falls below the k-th best score found is
passed over without computing its product.

Vectors with a component of 2**14 or more lie in trees of their own, whose distances are
taken on vectors scaled to length about one. Where such a tree or such a query takes part,
bounds are fractions and the scores of entries within them Python integers, of any size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

SCALE = 1024
BLOCK = 4096
QUERIES = 1024
PAGE = 48
# Products and squared lengths of vectors within it are exact in 64 bits.
_LARGEST = 1 << 24
# From here on a float is a whole number of 1 / SCALE.
_WHOLE = float(1 << 43)
_NO_ID = np.iinfo(np.int64).max
_PAGES = "dim int, wide boolean, block int, page int, ids binary, vectors binary, distances binary, radii binary, children binary"


def quantised(rows: DataFrame, id_column="vec_id", vector_column="embedding") -> DataFrame:
    """``id``, ``dim``, ``wide``, ``vector``: floor(1024 x) of every component.

    Null vectors and vectors with a null or non-finite component are left out. The vector
    is bytes of int32; where ``wide``, since one of them is 2**24 or more, bytes of
    float64, divided by 1024 (see :func:`whole`).
    """

    def run(batches):
        for batch in batches:
            keep, made, size, wide = [], [], [], []
            for i, vector in enumerate(batch.column(1)):
                if not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                small = np.abs(x) < _WHOLE
                x[small] = np.floor(SCALE * x[small]) / SCALE
                keep.append(i)
                size.append(len(x))
                wide.append(bool(len(x)) and np.abs(x).max() >= _LARGEST / SCALE)
                made.append(x.astype("<f8").tobytes() if wide[-1] else (SCALE * x).astype("<i4").tobytes())
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(size, pa.int32()), pa.array(wide, pa.bool_()),
                 pa.array(made, pa.binary())],
                names=["id", "dim", "wide", "vector"])

    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).mapInArrow(
        run, "id long, dim int, wide boolean, vector binary")


def whole(vector: np.ndarray) -> list[int]:
    """The integers of a wide vector's floats: 1024 times each, without overflow."""
    return [SCALE * int(x) if abs(x) >= _WHOLE else int(SCALE * x) for x in vector.tolist()]


def _scaled(vectors: np.ndarray):
    """Floats divided by a power of two that brings the largest below one; its exponent."""
    power = int(np.frexp(np.abs(vectors).max())[1]) if vectors.size else 0
    # In two steps, since one power of two may be beyond a float.
    return np.ldexp(np.ldexp(vectors, -(power // 2)), power // 2 - power), power


def _distances(points, centre):
    return np.sqrt(((points - centre) ** 2).sum(1).astype(np.float64))


def build(ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
    """Pages (ids, vectors, distances to the parent, radii, children) of a tree over
    int64 or scaled vectors; page 0 is the root. Leaf entries have radius 0 and child -1."""
    pages: list = []
    rng = np.random.default_rng(len(ids))

    def node(members, parent):
        number = len(pages)
        pages.append(None)
        if len(members) <= page:
            part = vectors[members]
            pages[number] = (ids[members], part, _distances(part, parent), np.zeros(len(members)),
                             np.full(len(members), -1))
            return number
        pivots = members[rng.choice(len(members), min(page, -(-len(members) // page) * 2), replace=False)]
        centres = np.unique(vectors[pivots], axis=0)
        if len(centres) == 1:
            nearest = np.arange(len(members)) * 2 // len(members)
            centres = np.repeat(centres, 2, axis=0)
        else:
            points, mid = vectors[members].astype(np.float64), centres.astype(np.float64)
            nearest = ((mid**2).sum(1) - 2 * points @ mid.T).argmin(1)
            if (nearest == nearest[0]).all():
                nearest = np.arange(len(members)) * len(centres) // len(members)
        radii, children, used = [], [], []
        for i in range(len(centres)):
            part = members[nearest == i]
            if len(part):
                used.append(i)
                radii.append(_distances(vectors[part], centres[i]).max())
                children.append(node(part, centres[i]))
        routing = centres[used]
        pages[number] = (np.full(len(used), -1), routing, _distances(routing, parent), np.array(radii),
                         np.array(children))
        return number

    if len(ids):
        node(np.arange(len(ids)), np.zeros(vectors.shape[1], vectors.dtype))
    return pages


def search(pages, query: np.ndarray, k: int, own: int):
    """The k best (score, id) of a tree, larger scores first, then smaller ids; entries
    with id ``own`` are left out. Also the number of products computed."""
    length, best, computed = float(np.sqrt((query.astype(np.float64) ** 2).sum())), [], 0
    queue = [(-np.inf, 0, 0.0)] if pages else []

    def least():
        return best[0][0] if len(best) == k else -np.inf

    while queue:
        bound, page, above = heapq.heappop(queue)
        if -bound < least():
            break
        ids, vectors, distances, radii, children = pages[page]
        # A hair of slack for the rounding of roots; scores themselves are integers.
        hope = above + length * (distances + radii) * (1 + 1e-9) + 1e-3
        open_ = np.flatnonzero(hope >= least())
        if not len(open_):
            continue
        products = vectors[open_] @ query
        computed += len(open_)
        if children[0] < 0:
            good = products >= least()
            for name, score in zip(ids[open_[good]].tolist(), products[good].tolist()):
                if name != own:
                    item = (score, -name)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
        else:
            bounds = products + length * radii[open_] * (1 + 1e-9) + 1e-3
            for j, bound, product in zip(open_, bounds, products):
                if bound >= least():
                    heapq.heappush(queue, (-bound, int(children[j]), float(product)))
    return sorted(best, reverse=True), computed


def search_wide(pages, power: int, query: np.ndarray, k: int, own: int):
    """As :func:`search` for vectors and a query of floats, 1024 times less than their
    integers; ``power`` scales the vectors as distances and radii are already."""
    best, computed = [], 0
    asked, more = _scaled(query)
    integers, length = whole(query), float(np.sqrt((asked**2).sum()))
    # More than sums of products of scaled floats can be off by rounding.
    slack = 1e-12 + 1e-15 * len(query) ** 2
    # What a product of scaled vectors is multiplied by to give a score: two to this.
    shift = power + more + 20
    queue = [(-np.inf, 0, 0.0)] if pages else []

    def least():
        if len(best) < k:
            return -np.inf
        score = best[0][0]
        return score / (1 << shift) if shift >= 0 else float(score * (1 << -shift))

    while queue:
        bound, page, above = heapq.heappop(queue)
        if -bound < least() - slack:
            break
        ids, vectors, distances, radii, children = pages[page]
        open_ = np.flatnonzero(above + length * (distances + radii) * (1 + 1e-9) + slack >= least() - slack)
        if not len(open_):
            continue
        halved = np.ldexp(np.ldexp(vectors[open_], -(power // 2)), power // 2 - power)
        products = halved @ asked
        computed += len(open_)
        if children[0] < 0:
            for j in open_[products + slack >= least() - slack]:
                if ids[j] != own:
                    item = (sum(map(int.__mul__, whole(vectors[j]), integers)), -int(ids[j]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
        else:
            bounds = products + length * radii[open_] * (1 + 1e-9) + slack
            for j, bound, product in zip(open_, bounds, products):
                if bound >= least() - slack:
                    heapq.heappush(queue, (-float(bound), int(children[j]), float(product)))
    return sorted(best, reverse=True), computed


def _matrix(column, wide: bool) -> np.ndarray:
    kind, kept = ("<f8", np.float64) if wide else ("<i4", np.int64)
    return np.stack([np.frombuffer(v.as_buffer(), kind).astype(kept) for v in column])


def _tree(group: pa.Table) -> pa.Table:
    dim, wide = group.column("dim")[0].as_py(), group.column("wide")[0].as_py()
    ids = group.column("id").fill_null(_NO_ID).to_numpy()
    vectors = _matrix(group.column("vector"), wide)
    order = np.lexsort((*vectors.T, ids)) if dim else np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    power = 0
    if wide:
        vectors, power = _scaled(vectors)
    pages = build(ids, vectors)
    n = len(pages)
    if wide:  # Pages keep the floats themselves.
        pages = [(i, np.ldexp(np.ldexp(v, power // 2), power - power // 2), *rest) for i, v, *rest in pages]
    return pa.table({
        "dim": pa.array([dim] * n, pa.int32()), "wide": pa.array([wide] * n, pa.bool_()),
        "block": pa.array([group.column("block")[0].as_py()] * n, pa.int32()),
        "page": pa.array(range(n), pa.int32()),
        **{name: pa.array([p[i].astype(kind).tobytes() for p in pages], pa.binary()) for i, (name, kind) in enumerate(
            (("ids", "<i8"), ("vectors", "<f8" if wide else "<i4"), ("distances", "<f8"), ("radii", "<f8"),
             ("children", "<i4")))}})


_FOUND = "query_id long, vec_id long, score long, size int, digits binary"


def _sortable(score: int):
    """Size and digits that order integers of any size as they are themselves."""
    size = (abs(score).bit_length() + 7) // 8
    if score < 0:
        return -size, (256**size - 1 + score).to_bytes(size, "big")
    return size, score.to_bytes(size, "big")


def _searcher(k):
    def floats(vectors, wide):
        return vectors if wide else vectors.astype(np.float64) / SCALE

    def run(tree: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [], [], [])
        if tree.num_rows and queries.num_rows:
            tree = tree.sort_by("page")
            dim, wide = tree.column("dim")[0].as_py(), tree.column("wide")[0].as_py()
            pages = [tuple(np.frombuffer(x.as_buffer(), t).astype(k_) for x, (t, k_) in zip(row, (
                ("<i8", np.int64), ("<f8", np.float64) if wide else ("<i4", np.int64), ("<f8", np.float64),
                ("<f8", np.float64), ("<i4", np.int64))))
                for row in zip(*(tree.column(n) for n in ("ids", "vectors", "distances", "radii", "children")))]
            pages = [(i, v.reshape(len(i), dim), d, r, c) for i, v, d, r, c in pages]
            scaled = None
            for own, asked_wide, vector in zip(
                    queries.column("id").to_pylist(), queries.column("asked_wide").to_pylist(), queries.column("vector")):
                query = np.frombuffer(vector.as_buffer(), "<f8" if asked_wide else "<i4")
                if wide or asked_wide:
                    scaled = scaled or _as_floats(pages, wide)
                    found, _ = search_wide(*scaled, floats(query, asked_wide), k, own)
                else:
                    found, _ = search(pages, query.astype(np.int64), k, own)
                for score, name in found:
                    size, digits = _sortable(score)
                    fits = -(1 << 63) <= score < 1 << 63
                    for column, value in zip(out, (own, None if -name == _NO_ID else -name,
                                                   score if fits else None, size, digits)):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)],
                        names=["query_id", "vec_id", "score", "size", "digits"])

    return run


def _as_floats(pages, wide):
    """A tree's pages and the power of its scale, for :func:`search_wide`."""
    if not wide:
        pages = [(i, v / SCALE, d / SCALE, r / SCALE, c) for i, v, d, r, c in pages]
    power = _scaled(np.concatenate([p[1] for p in pages]))[1]
    if not wide:
        pages = [(i, v, np.ldexp(d, -power), np.ldexp(r, -power), c) for i, v, d, r, c in pages]
    return pages, power


def top_k(rows: DataFrame, *, k: int = 10, every: int = 100, id_column="vec_id",
          vector_column="embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's k highest
    inner products; ties go to the smaller id, ids that are null last.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with
    another id. Vectors are compared with those of the same number of components; see
    :func:`quantised` for those left out. Finite components of any size are exact; a score
    beyond 64 bits is ranked by its value and given as null. Of query rows with one id, the one with the
    least bytes counts; repeated candidates are all candidates. No rows give no rows.
    """
    usable = cut_lineage(quantised(rows, id_column, vector_column))
    blocks = max(1, -(-usable.count() // block))
    asked = usable.where(F.col("id") % every == 0).groupBy("dim", "id").agg(
        F.min(F.struct("vector", "wide")).alias("least")).select("dim", "id", "least.*")
    parts = max(1, -(-usable.where(F.col("id") % every == 0).count() // queries))

    def dealt(name, n, *columns):
        return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int").alias(name)

    trees = cut_lineage(usable.select("*", dealt("block", blocks, "id", "vector")).groupBy(
        "dim", "wide", "block").applyInArrow(_tree, _PAGES))
    trees = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.select("*", dealt("part", parts, "id")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Every query meets the trees of both widths; there are wide ones only where rows are.
    widths = [r["wide"] for r in usable.select("wide").distinct().collect()]
    asked = asked.withColumnRenamed("wide", "asked_wide").withColumn(
        "wide", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<boolean>")))
    keys = ["dim", "wide", "block", "part"]
    asked = asked.select(*keys, "id", "vector", "asked_wide")
    found = trees.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_searcher(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("digits"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
