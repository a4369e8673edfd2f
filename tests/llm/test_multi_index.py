"""Hard negatives against brute force, the index's bounds, and odd rows."""

import math

import numpy as np
import pytest

from millrace.llm import multi_index, vectors

MOST = vectors.MOST


def _brute(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = []
    for name, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((name, label, [math.floor(scale * float(np.float32(x))) for x in vector]))

    def ranked(found):
        return sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))

    anchors, out = {}, []
    for name, label, v in kept:
        if name is not None and name % every == 0:
            key = (len(v), label, np.array(v, "<f8").tobytes())
            anchors[name] = min(anchors.get(name, (key, v)), (key, v))
    for name, ((dim, label, _), v) in anchors.items():
        scored = [(max(-MOST, min(MOST, sum(a * b for a, b in zip(v, w)))), other, own) for other, own, w in kept
                  if other != name and len(w) == dim]
        best = ranked([s for s in scored if s[2] == label])[:positives]
        for score, positive, _ in best:
            fit = ranked([s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score])
            out += [(name, positive, rank, negative, score, s) for rank, (s, negative, _) in enumerate(fit[:negatives], 1)]
    return sorted(out, key=str)


def _clustered(n=900, dim=12, clusters=25, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    own = r.integers(0, clusters, n)
    made = centres[own] + 0.25 * r.normal(size=(n, dim))
    return [(i, v.tolist(), int(c) % 4) for i, (v, c) in enumerate(zip(made, own))]


DDL = "vec_id long, embedding array<float>, label int"


def _got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("size", [{}, {"per_cell": 8, "codewords": 9, "sample": 200}])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(multi_index, "SHARD", 64)
    rows = _clustered()
    # A third of all rows alike, one of them an anchor.
    rows += [(5000 + i, rows[10][1], 1 if i % 5 else 2) for i in range(400)]
    got = multi_index.hard_negatives(spark.createDataFrame(rows, DDL).repartition(4), **size)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                          ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert _got(got) == _brute(rows)


def test_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-3, 4, 3).astype(float).tolist(), int(i % 2)) for i in range(120)]
    rows += [(None, [1.0, 2.0, 3.0], 0), (None, [3.0, 2.0, 1.0], 1), (50, [2.0, 2.0, 2.0], 1), (50, [2.0, 2.0, 2.0], 1),
             (7, None, 1), (8, [1.0, None, 2.0], 0), (9, [float("nan"), 1.0, 1.0], 0), (10, [float("inf"), 1.0, 1.0], 0),
             (11, [1.0, 1.0, 1.0], None), (200, [1.0, 2.0], 0), (201, [2.0, 2.0], 0), (202, [1.0, 1.0], 1), (250, [], 1),
             (251, [], 1), (252, [], 0), (300, [5.0], 0), (400, [0.0, 0.0, 0.0], 0), (401, [-0.004, 0.0, 0.0], 1)]
    more = "w int, id string, score double, dim int, vector string, place int, lows int, shard int"
    odd = (1, "x", 2.0, 3, "v", 4, 5, 6)
    frame = spark.createDataFrame([(*row, *odd) for row in rows], f"{DDL}, {more}")
    assert _got(multi_index.hard_negatives(frame, per_cell=8)) == _brute(rows)
    assert multi_index.hard_negatives(frame.limit(0)).count() == 0


def test_large_components(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.normal(size=4) * 10.0 ** int(r.choice((0, 5, 9, 20, 37)))).tolist(), int(i % 2)) for i in range(160)]
    assert _got(multi_index.hard_negatives(spark.createDataFrame(rows, DDL), per_cell=8)) == _brute(rows)


def test_products_are_exact():
    r = np.random.default_rng(1)
    for a_scale, b_scale in ((1e3, 1e3), (1e8, 1e7), (1e12, 3), (1e30, 1e30)):
        a, b = np.floor(r.normal(size=(7, 5)) * a_scale), np.floor(r.normal(size=(9, 5)) * b_scale)
        want = [[max(-MOST, min(MOST, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert vectors.products(a, b).tolist() == want


def _index(points):
    books = multi_index.fit([(points.shape[1], p.astype("<f8").tobytes()) for p in points], {points.shape[1]: len(points)},
                            per_cell=4)
    dim = points.shape[1]
    i, one = multi_index.nearest_of(points[:, : dim // 2], books[dim][0])
    j, two = multi_index.nearest_of(points[:, dim // 2 :], books[dim][1])
    cells = {}
    for n in range(len(points)):
        c = cells.setdefault((int(i[n]), int(j[n])), [0, 0.0, 0.0])
        cells[int(i[n]), int(j[n])] = [c[0] + 1, max(c[1], one[n]), max(c[2], two[n])]
    index = multi_index.Index(books, [(dim, a, b, *c) for (a, b), c in cells.items()])
    return index, index.dims[dim]["at"][i, j]


def test_visits_are_whole_and_few():
    """No row of a window lies in a cell that is not visited; clusters leave most cells out."""
    points = np.floor(256 * np.array([v for _, v, _ in _clustered(2000, clusters=40, seed=3)]))
    index, cell = _index(points)
    shares = []
    for q in points[::100]:
        scores = points @ q
        assert sorted(index.visits(q, [(-MOST, MOST, -MOST)])) == sorted(set(cell.tolist()))
        for low, high in ((scores.max() * 0.8, MOST), (scores.max() * 0.5, scores.max() * 0.6)):
            seen = index.visits(q, [(low, high, low)])
            inside = (scores >= low) & (scores <= high)
            assert set(cell[inside].tolist()) <= set(seen) and len(set(seen)) == len(seen)
            shares.append(np.isin(cell, seen).mean())
        assert len(index.visits(q, [(-MOST, MOST, -MOST)], limit=50)) < len(set(cell.tolist()))
    assert np.mean(shares) < 0.5
