"""Token ids in files: exact round trips, whole query against the tokenizer, odd rows."""

import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import mixcoder, queries


def _brute(rows):
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for name, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = full.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 255, 257, 5000, 70_001])
def test_round_trip_of_blocks(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 50257, n), np.minimum(r.geometric(0.01, n), 65535), np.zeros(n, int),
                np.tile(r.integers(0, 65536, 37), n // 37 + 1)[:n], np.full(n, 65535)):
        lanes, payload = mixcoder.encode(ids)
        assert np.array_equal(mixcoder.decode(payload, n, lanes), ids)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 65535) | st.integers(0, 3), max_size=900), st.integers(1, 7))
def test_round_trip_of_any_ids(ids, steps):
    ids, kept = np.array(ids, np.int64), mixcoder._lanes
    mixcoder._lanes = lambda n: kept(n, steps)
    try:
        lanes, payload = mixcoder.encode(ids)
    finally:
        mixcoder._lanes = kept
    assert np.array_equal(mixcoder.decode(payload, len(ids), lanes), ids)


def test_repeats_cost_little():
    """Each of the orders does its share."""
    r = np.random.default_rng(3)
    uniform = r.integers(0, 50257, 60_000)
    skewed = np.minimum(r.geometric(0.05, 60_000), 50_000)
    follows = np.cumsum(r.integers(0, 2, 60_000)) * 7919 % 50257
    phrase = np.tile(r.integers(0, 50257, 300), 200)
    bits = [len(mixcoder.encode(x)[1]) * 8 / len(x) for x in (uniform, skewed, follows, phrase)]
    assert bits[0] < 19 and bits[1] < 9 and bits[3] < 3


def test_intervals_cover_the_total():
    """Intervals of all ids lie next to each other and fill the total, and each point
    belongs to the id that the reader finds."""
    r = np.random.default_rng(1)
    model = mixcoder.Model(16)
    for turn in range(40):
        model.predict()
        ids = np.where(r.random(16) < 0.6, r.integers(0, 5, 16), r.integers(0, 65536, 16))
        for lane in (0, 7):
            edges = np.unique(np.concatenate([ids, model.id1, model.id2, [0, 65535]]))
            edges = np.unique(np.concatenate([edges, np.minimum(edges + 1, 65535)])).astype(np.int64)
            for one in edges:
                every = np.full(16, one)
                start, size = (x.astype(np.int64) for x in model.interval(every, every.astype(np.int32)))
                assert size.min() > 0 and (start + size).max() <= 1 << 26
                for point in (start, start + size // 2, start + size - 1):
                    assert (model.at_point(point.astype(np.int32)) == one).all()
            every = np.full(16, 65535)
            start, size = (x.astype(np.int64) for x in model.interval(every, every.astype(np.int32)))
            assert (start + size == 1 << 26).all()
        model.interval(ids, ids.astype(np.int32))
        model.learn(ids, ids.astype(np.int32), turn)


def test_damage_is_found():
    made = mixcoder.block(np.arange(500), [(1, 500, 3)], 0)
    assert len(list(mixcoder.blocks(made + made))) == 2
    for bad in (made[:-1], made[:20], made[:60] + bytes([made[60] ^ 1]) + made[61:], b"x" + made):
        with pytest.raises(ValueError):
            list(mixcoder.blocks(bad))


ROWS = [(5, "a text"), (3, None), (3, ""), (9, "!" * 40), (None, "no id"), (-2, "é ñ 漢字 <|endoftext|>"),
        (7, "again and again " * 900), (5, "another with the id"), (5, "a text"), (None, None)]


@pytest.mark.parametrize("size", [{}, {"per_block": 100, "file_bytes": 200}])
def test_files_of_odd_rows(spark, tmp_path, size):
    more = "file long, place string, ids_crc32 int, start long, value string"
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, "v") for r in ROWS], f"doc_id long, text string, {more}")
    path = str(tmp_path / "ids")
    mixcoder.write_ids(docs.repartition(3), path, **size)
    got = mixcoder.with_starts(mixcoder.read_ids(spark, path, ids=True)).orderBy("start").collect()
    want = _brute(ROWS)
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]))
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (str(a), n, c) for a, _, n, c in want)
    assert all(zlib.crc32(np.array(r["ids"], "<u4")) == r["ids_crc32"] for r in got)


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    mixcoder.write_ids(spark.createDataFrame([], "doc_id long, text string"), path)
    assert mixcoder.with_starts(mixcoder.read_ids(spark, path)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = queries.all_queries()["op13_mixcoder"](spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(_brute(map(tuple, docs)))
