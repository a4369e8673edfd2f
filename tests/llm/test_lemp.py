"""Ranked lexical search against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lemp

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _brute(docs, queries, k=20):
    counted = [(name, Counter(t), len(t)) for name, t in ((n, _terms(x)) for n, x in docs)]
    documents, total = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    having = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in queries:
        asked, scores = _terms(text), []
        for name, found, n in counted:
            m = 100 - 25 + (25 * n * documents // total if total else 0)
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * having[t] + 1)))
                        * (10**9 * found[t] // (1000 * found[t] + 12 * m)) for t in asked if t in found)
            if score > 0:
                scores.append((-score, name is None, name or 0))
        out += [(item, rank, None if none else name, -s)
                for rank, (s, none, name) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def _got(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: (str(r[0]), r[1]))


def test_terms():
    assert lemp.terms("A-b_C3 É漢 z\x00y\x7fx") == [w.encode() for w in _terms("A-b_C3 É漢 z\x00y\x7fx")]
    assert lemp.terms(None) == lemp.terms(" .,\n") == []


@pytest.mark.parametrize("bucket", [3, 64, 1024])
def test_against_brute_force(spark, bucket):
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(r.choices(words, odds, k=r.choice((3, 30, 200))))) for i in range(500)]
    # Copies: equal scores, and a third of all rows alike.
    docs += [(1000 + i, docs[7][1]) for i in range(250)] + [(7, docs[7][1])]
    queries = [(i, " ".join(r.choices(words, odds, k=40)) + " " + docs[i][1]) for i in range(25)]
    queries.append((99, "nothing of this is there"))
    got = lemp.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                      spark.createDataFrame(queries, "item_id long, text string"), bucket=bucket)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert _got(got) == _brute(docs, queries)


def test_odd_rows_and_blocks_of_queries(spark):
    docs = [(3, "Apple apple PEAR"), (3, "apple"), (None, "apple pear"), (None, "apple pear"), (5, None), (6, ""),
            (7, "--- ..."), (8, "pear " * 50_000), (9, "É é 漢字"), (10, "Apple apple PEAR")]
    queries = [(1, "apple APPLE pear"), (2, None), (4, ""), (None, "é"), (1, "zzz"), (5, "É 漢字"), (6, "pear")]
    more = "score long, rank int, length double, q long, terms string, n long"
    frame = spark.createDataFrame([(*d, 1, 2, 3.0, 4, "t", 5) for d in docs], f"doc_id long, text string, {more}")
    asked = spark.createDataFrame([(*q, 1, 2, 3.0, 4, "t", 5) for q in queries], f"item_id long, text string, {more}")
    want = _brute(docs, [q for q in queries if q != (1, "zzz")], k=3)
    for size in (1 << 20, 10):
        assert _got(lemp.search(frame, asked, k=3, query_bytes=size)) == want
    none, nothing = frame.limit(0), asked.limit(0)
    assert lemp.search(none, asked).count() == lemp.search(frame, nothing).count() == 0


def test_bounds_prune():
    """Buckets of short vectors are not opened, and coordinates thin the opened ones."""
    r = np.random.default_rng(2)
    weight = np.array([5000, 3000, 100, 50, 10])
    queries = lemp._Queries([{0: 1, 1: 2, 2: 1, 4: 3}], weight)
    sizes = r.integers(1, 5, 4000)
    numbers = np.concatenate([r.choice(5, n, replace=False) for n in sizes])
    counts = r.integers(1, 4, len(numbers))
    m = r.integers(75, 200, 4000)
    row = np.repeat(np.arange(4000), sizes)
    gains = lemp._gains(counts, m[row])
    lengths = np.sqrt(np.bincount(row, weight[numbers] * gains.astype(float) ** 2))
    exact = np.bincount(row, np.array([1, 2, 1, 0, 3])[numbers] * weight[numbers] * gains).astype(np.int64)
    floor = int(np.sort(exact)[-20])
    assert (queries.lengths[0] * lengths * (1 + 1e-9) >= exact).all()
    parts = [(np.arange(4000), m, lengths, sizes, numbers, counts)]
    found = opened = 0
    for b in lemp._buckets(parts, weight, 100):
        if queries.lengths[0] * b.lengths[0] * (1 + 1e-9) >= floor:
            opened += 1
            found += len(b.candidates(queries, 0, weight, floor)[0])
    assert found == (exact >= floor).sum() and opened < 40
