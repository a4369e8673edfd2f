"""The ten operators against brute force, and on odd rows: nulls, empty and long texts,
ties, repeated rows, empty tables, further columns with clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import (
    html_blocks, html_crf, html_samples, lengths, mixing, mtree, order_minhash, packing, quality,
    simhash, substring, warc,
)
from millrace.llm.components import components
from millrace.llm.tokens import encoder

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, id string"
VOCABULARY = [f"w{i}" for i in range(400)]


def _docs():
    r = random.Random(4)
    texts = [" ".join(r.choices(VOCABULARY, k=r.randint(1, 90))) for _ in range(40)]
    shared = " ".join(r.choices(VOCABULARY, k=30))
    texts += [f"{' '.join(r.choices(VOCABULARY, k=9))}\n{shared} {' '.join(r.choices(VOCABULARY, k=7))}" for _ in range(6)]
    texts += [texts[3], texts[3], texts[5].upper(), "", None, " \t\n", "é" * 50, "a" * 5000,
              " ".join(r.choices(VOCABULARY, k=30_000)), shared, "word " * 40]
    return [(i, t, None if i % 7 == 0 else "en", "s0" if i % 3 else None, 1, 0.5, 1, "x") for i, t in enumerate(texts)]


ROWS = _docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1 ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def field():
    return html_crf.fit(html_samples.labelled_pages(200))


def test_field_on_other_pages(field):
    wrong = total = 0
    for markup, labels in html_samples.labelled_pages(80, seed=9):
        found = field.decode(html_blocks.blocks(markup))
        wrong += sum(a != b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_viterbi_is_the_best_of_all_labellings(field):
    for markup, _ in html_samples.labelled_pages(30, seed=5):
        page = html_blocks.blocks(markup)[:9]
        scores = field.scores(page)

        def value(labels):
            return sum(scores[i, y] for i, y in enumerate(labels)) + sum(
                field.step[a, b] for a, b in zip(labels, labels[1:]))

        best = max(value(x) for x in itertools.product((0, 1), repeat=len(page)))
        assert value(field.decode(page)) == pytest.approx(best)


def test_extract(spark, field):
    article = "<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One  two\n<b>thr</b>ee.<p>Four &lt; five, six.</article>"
    rows = [(1, "u", article + "<footer>&copy; x</footer>", "old"), (1, "u", article, "old"), (2, None, None, None),
            (None, "v", "", "t"), (3, "w", "no tags < here", "t"), (4, "w", "<script>var a='</p>'", "t"),
            (5, "w", "<article><p>" + "Long words. " * 50_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_crf.extract(df, field=field)
    assert out.columns == ["page_id", "url", "text"]
    found = out.collect()
    assert [r["text"] for r in found[:2]] == ["A & B One two three. Four < five, six."] * 2
    assert [r["text"] for r in found[2:4]] == ["", ""] and found[5]["text"] == ""
    assert len(found[6]["text"]) == len("Long words. " * 50_000) - 1
    assert html_crf.extract(df.limit(0), field=field).count() == 0


def test_text_in_formulas_drawings_and_noscript(field):
    page = ("<noscript>You need scripts to run this site.</noscript><nav><a href=/>Home</a></nav><article><h1>Title one</h1>"
            "<p>Before <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> after the formula, as said.</p>"
            "<svg viewBox='0 0 9 9'><title>icon</title><path d='M0'/><text x=1>North</text><text>South</text></svg>"
            "<noscript><p>A table of values, in words for all readers.</p></noscript>"
            "<p>Icon<svg><path d='M1'></path></svg>s stay in their line, here as there.</p></article>")
    assert [b.text for b in html_blocks.blocks(page)][3:5] == [
        "Before x=2 after the formula, as said.", "North South"]
    assert html_crf.main_text(field, page) == (
        "Title one Before x=2 after the formula, as said. North South A table of values, in words for all readers. "
        "Icons stay in their line, here as there.")


def test_extract_with_clashing_columns(spark, field):
    df = spark.createDataFrame([(1, "<article><p>One, two.</p></article>", "a", "b")],
                               "page_id long, html string, __html string, n_chars string")
    assert [tuple(r) for r in html_crf.extract(df, field=field).collect()] == [(1, "a", "b", "One, two.")]


# 2 ---------------------------------------------------------------------------
def test_compare_with_next(docs, none):
    found = {r["id"]: r for r in order_minhash.compare_with_next(docs, range_bytes=500).collect()}
    rows = sorted(ROWS, key=lambda r: -r[0])
    prints = {}
    for row, after in zip(rows, rows[1:] + rows[:1]):
        text, n = row[1] or "", len(row[1] or "")
        edited = text[: n - n // 2] + (after[1] or "")[: n // 2]
        made = found[row[0]]
        assert made["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and made["n_chars"] == n
        assert prints.setdefault(text, made["fingerprint"]) == made["fingerprint"]
        if n > 200 and 0 < row[0] < 40:
            assert made["near_next"] < made["near_edited"] < 1
        if edited == text:
            assert made["near_edited"] == 1
    assert len(found) == len(ROWS)
    assert order_minhash.compare_with_next(none).count() == 0


def test_order_counts(spark):
    a = [f"x{i}" for i in range(60)]
    texts = [" ".join(a), " ".join(a[30:] + a[:30]), " ".join(a[:57] + ["y"] * 3)]
    made = order_minhash.signatures(spark_free(texts))
    moved, changed = order_minhash.likeness(made[[0, 0]], made[1:])
    assert moved < 0.6 < changed < 1
    single = spark.createDataFrame([(1, "one two"), (None, None)], "doc_id long, text string")
    assert {r["id"] for r in order_minhash.compare_with_next(single).collect()} == {1, None}


def spark_free(texts):
    import pyarrow as pa

    return pa.array(texts)


# 3 ---------------------------------------------------------------------------
def _check_packing(rows, texts, capacity):
    ids = {k: np.array(encoder().full.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
           for k, t in texts.items()}
    at = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(own)
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : at[r["doc_id"]]].tobytes())
    assert at == {k: len(v) for k, v in ids.items()}
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), lambda r: r["sequence_id"]):
        end = 0
        for r in group:
            assert r["offset"] == end
            end += r["length"]
        assert end == capacity or end & (end - 1) == 0


@pytest.mark.parametrize("capacity,per_group", [(2048, 512), (64, 5)])
def test_pack(docs, capacity, per_group):
    rows = packing.pack(docs, capacity=capacity, per_group=per_group).collect()
    _check_packing(rows, {r[0]: r[1] for r in ROWS}, capacity)


def test_pack_odd_rows(spark, none):
    assert packing.pack(none).count() == 0
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, None), (None, "x <|endoftext|>")], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert sum(r["length"] for r in rows) == sum(
        len(encoder().full.encode(t, add_special_tokens=False).ids) + 1 for t in ("same", "same", "", "x <|endoftext|>"))


def test_first_fit_decreasing_like_a_plain_loop():
    r = random.Random(2)
    for _ in range(20):
        lengths_ = [r.randint(1, 99) for _ in range(r.randint(1, 70))]
        room, plain = [], {}
        for i in sorted(range(len(lengths_)), key=lambda i: (-lengths_[i], i)):
            bin_ = next((b for b, free in enumerate(room) if free >= lengths_[i]), None)
            if bin_ is None:
                room.append(100)
                bin_ = len(room) - 1
            room[bin_] -= lengths_[i]
            plain.setdefault(bin_, []).append((i, 0, lengths_[i]))
        assert packing.first_fit_decreasing(lengths_, 100) == list(plain.values())


def test_tokens_agree_with_the_tokenizer():
    r = random.Random(1)
    signs = "abcéñß  .,'!\n\t ​中文🙂0١<|endoftext|>"
    for _ in range(300):
        text = "".join(r.choices(signs, k=r.randint(0, 40)))
        assert encoder().ids(text) == encoder().full.encode(text, add_special_tokens=False).ids


# 4 ---------------------------------------------------------------------------
def test_token_counts(docs, none):
    sizes = sorted(len(encoder().ids(r[1])) for r in ROWS)
    found = lengths.context_limits(lengths.histogram(lengths.encoded_lengths(docs))).collect()
    assert {r["context_limit"] for r in found} == set(sizes) | set(lengths.LIMITS)
    for r in found:
        limit = r["context_limit"]
        assert r["documents"] == sizes.count(limit)
        assert r["documents_longer"] == sum(n > limit for n in sizes)
        assert r["tokens_longer"] == sum(n for n in sizes if n > limit)
        assert r["documents_within"] == sum(n <= limit for n in sizes)
        assert r["truncated_tokens"] == sum(min(n, limit) for n in sizes)
        assert r["quantile"] == pytest.approx(r["documents_within"] / len(sizes))
    counts = lengths.histogram(lengths.encoded_lengths(docs))
    assert lengths.quantile(counts, 0.5).first()[0] == sizes[(len(sizes) + 1) // 2 - 1]
    empty = lengths.context_limits(lengths.histogram(lengths.encoded_lengths(none)), (8,)).first()
    assert empty["documents_within"] == 0 and empty["quantile"] is None


# 5 ---------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    r = random.Random(3)
    long = "".join(r.choices("ab\r\n é", k=9000))
    rows = [(1, "http://a/ b\nc", "x" * 1200), (2, None, "x" * 1200), (3, "u", "short"), (4, "u", "short"), (5, "u", None),
            (None, "u", "x" * 1200), (6, "u", ""), (7, "u", long), (8, "u", "\r\n" * 700), (9, "u", "WARC/1.0\r\n\r\n"), (7, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(warc.revisits(df), path, segment=1000)
    chunks = warc.read_chunks(spark, path, chunk=300).collect()
    last = [c for c in chunks if c["last"]]
    assert len(last) == len(rows)
    kinds = {(c["page_id"], c["record_type"], c["refers_to"]) for c in last}
    assert (1, "revisit", 2) in kinds and (None, "revisit", 2) in kinds and (2, "response", None) in kinds
    for page, _, html in rows:
        body = (html or "").encode()
        own = [c for c in last if c["page_id"] == page]
        assert {(c["bytes_so_far"], c["digest_so_far"]) for c in own} == {(len(body), hashlib.sha1(body).hexdigest())}
        if page not in (1, None, 7):
            parts = sorted((c for c in chunks if c["page_id"] == page), key=lambda c: c["chunk"])
            assert b"".join(bytes(c["payload"]) for c in parts) == body
            assert all(len(c["payload"]) <= 300 for c in parts)
    assert sum(c["record_type"] == "response" for c in last if c["page_id"] == 7) == 2
    warc.write_warc(warc.revisits(df.limit(0)), path + "0")
    assert warc.read_chunks(spark, path + "0").count() == 0


def test_warc_files_end_between_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_ROWS", 1)
    df = spark.createDataFrame([(i, None, f"{i}\r\n" * 100 * i) for i in range(6)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(warc.revisits(df), path, segment=50)
    last = {r["page_id"]: r for r in warc.read_chunks(spark, path, chunk=30).where("last").collect()}
    assert {i: r["bytes_so_far"] for i, r in last.items()} == {i: 300 * i for i in range(6)}


@pytest.mark.parametrize("keep", [1, 2])
def test_warc_file_that_ends_within_a_page(spark, tmp_path, keep):
    digest = hashlib.sha1(b"x" * 120).hexdigest()
    parts = list(warc.records(1, "u", b"x" * 120, digest, None, 50))
    assert len(parts) == 3
    (tmp_path / "a.warc").write_bytes(b"\r\n".join(parts[:keep]) + b"\r\n")
    (tmp_path / "b.warc").write_bytes(next(warc.records(2, "u", b"y", hashlib.sha1(b"y").hexdigest(), None)) + b"\r\n")
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_chunks(spark, str(tmp_path)).collect()


# 6 ---------------------------------------------------------------------------
def _cut_plainly(rows, window):
    first = {}
    for key, text in rows:
        w = _words(text)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, key), key)
    out = {}
    for key, text in rows:
        w = _words(text)
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < key for j in range(window)}
        out[key] = (len(w), len(gone), [x for i, x in enumerate(w) if i not in gone])
    return out


@pytest.mark.parametrize("window,size", [(13, 1 << 20), (13, 300), (4, 300)])
def test_cut_repeats(docs, window, size):
    found = substring.cut_repeats(docs, window=window, chunk_bytes=size, bucket_bytes=size)
    assert found.columns == [*docs.columns, "n_words", "n_removed", "removed"]
    plain = _cut_plainly([(r[0], r[1]) for r in ROWS], window)
    got = found.collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["n_words"], r["n_removed"], _words(r["text"])) == plain[r["doc_id"]]
        assert sum(x["last"] - x["first"] + 1 for x in r["removed"]) == r["n_removed"]
        assert (r["text"] is None) == (ROWS[r["doc_id"]][1] is None) and r["source"] == ROWS[r["doc_id"]][3]


def test_cut_repeats_odd_rows(spark, none):
    assert substring.cut_repeats(none).count() == 0
    line = " ".join(VOCABULARY[:20])
    df = spark.createDataFrame([(5, line), (5, line), (None, line), (None, line)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_removed"]) for r in substring.cut_repeats(df).collect()}
    assert got == {(5, 0), (None, 20)}


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_cut_repeats_of_rows_that_share_an_id(spark, size):
    """A third of the rows without an id, a third of one id, further columns of any name."""
    r = random.Random(8)
    lines = [" ".join(r.choices(VOCABULARY, k=20)) for _ in range(12)]
    rows = [(None if i % 3 == 0 else 40 if i % 3 == 1 else i, f"{r.choice(lines)} {r.choice(lines)} {i}", f"l{i}", "w", "c", i)
            for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __local string, __words string, chunk string, local long")
    found = substring.cut_repeats(df.repartition(4), chunk_bytes=size, bucket_bytes=size).collect()
    starts = {}
    ranks = [float("inf") if row[0] is None else row[0] for row in rows]
    for rank, row in zip(ranks, rows):
        words = _words(row[1])
        for i in range(len(words) - 12):
            key = tuple(words[i : i + 13])
            starts[key] = min(starts.get(key, rank), rank)
    assert len(found) == 90
    for got in found:
        words, rank = _words(rows[got["local"]][1]), ranks[got["local"]]
        gone = {j for i in range(len(words) - 12) if starts[tuple(words[i : i + 13])] < rank for j in range(i, i + 13)}
        assert _words(got["text"]) == [w for j, w in enumerate(words) if j not in gone]
        assert got["__local"] == f"l{got['local']}" and (got["__words"], got["chunk"]) == ("w", "c")


# 7 ---------------------------------------------------------------------------
def test_top_k(spark):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(700, 8)).round(2)
    vectors[100:180] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(800, None), (900, [1.0, None] * 4), (1000, [float("nan")] * 8), (None, vectors[5].tolist()), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = mtree.top_k(df, block=150, queries=3).collect()
    whole = np.floor(1024 * vectors.astype(np.float32).astype(np.float64)).astype(int)
    for q in range(0, 700, 100):
        pairs = [(-int(whole[q] @ whole[i]), i) for i in range(700) if i != q] + [(-int(whole[q] @ whole[5]), 1 << 60)]
        best = [(i if i < 1 << 60 else None, -s) for s, i in sorted(pairs)[:10]]
        assert [(x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == best
    assert {x["query_id"] for x in got} == set(range(0, 700, 100))
    assert mtree.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("largest", [20_000.0, 1e13, 1e308])
def test_top_k_of_large_components(spark, largest):
    """Any finite component counts; scores beyond 64 bits rank by their value."""
    r = np.random.default_rng(3)
    vectors = r.normal(size=(240, 6)).round(2)
    vectors[::3] *= largest / 4
    vectors[5], vectors[7], vectors[120] = vectors[3], [largest, -largest, 0.5, 0, -1, 1], vectors[0]
    vectors = np.clip(vectors, -1.7e308, 1.7e308)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = mtree.top_k(df, every=20, block=50, queries=4).collect()
    whole = [[math.floor(1024 * Fraction(x)) for x in v] for v in vectors.tolist()]
    for q in range(0, 240, 20):
        pairs = [(-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(240) if i != q]
        best = [(i, -s if -(1 << 63) <= -s < 1 << 63 else None) for s, i in sorted(pairs)[:10]]
        assert [(x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == best


def test_tree_saves_products():
    r = np.random.default_rng(2)
    centres = r.integers(-900, 900, (20, 8))
    vectors = centres[r.integers(0, 20, 4000)] + r.integers(-20, 20, (4000, 8))
    pages = mtree.build(np.arange(4000), vectors)
    best, computed = mtree.search(pages, vectors[0], 10, own=0)
    scores = sorted(((int(v @ vectors[0]), -i) for i, v in enumerate(vectors) if i), reverse=True)[:10]
    assert best == scores and computed < 2000


# 8 ---------------------------------------------------------------------------
def _component_roots(names, linked):
    root = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_near_duplicates(docs, none):
    got = {r["id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {r[0]: int(simhash.fingerprint(r[1], 4)[0]) for r in ROWS}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {k: r["component"] for k, r in got.items()} == _component_roots(prints, linked)
    assert got[50]["fp"] == got[49]["fp"] == 0
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("piece", [4, 2048])
def test_links_of_a_dense_cluster(spark, piece):
    r = random.Random(6)
    centre, made = r.getrandbits(63), {r.getrandbits(63) for _ in range(150)}
    for _ in range(200):
        made.add(centre ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)))
    made = sorted(made)
    df = spark.createDataFrame([(x, [x]) for x in made], "fp long, bits array<bigint>")
    edges = simhash.links(df, simhash.pigeonholes(6, 4), 4, piece=piece).collect()
    plain = [(a, b) for a, b in itertools.combinations(made, 2) if (a ^ b).bit_count() <= 4]
    assert all((e["a"] ^ e["b"]).bit_count() <= 4 for e in edges)
    assert _component_roots(made, [tuple(e) for e in edges]) == _component_roots(made, plain)


def test_keep_one(spark):
    r = random.Random(8)
    base = r.choices(VOCABULARY, k=300)
    near = list(base)
    near[150] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(r.choices(VOCABULARY, k=300))), (None, "a b")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"] for x in kept.collect()} == {1, 4, None}


def test_keep_one_of_short_and_borderline_texts(spark):
    r, texts = random.Random(12), []
    for n in (8, 8, 8, 8, 8, 8, 9, 10, 14, 24, 40, 60) * 3:
        words = [f"v{r.randint(0, 10**9)}" for _ in range(n)]
        # One word more or fewer at an end changes one shingle, one within it five.
        texts += [words, words + ["more"], words[2:], words[: n // 2] + ["x"] + words[n // 2 + 1 :]]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = [set(simhash.shingles(t, 5).tolist()) for _, t in rows]
    edges = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    names = list(range(len(rows)))
    for i, j in edges * 4:
        names[i] = names[j] = min(names[i], names[j])
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"] for x in kept.collect()} == {i for i, n in enumerate(names) if i == n}


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


# 9 ---------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out("doc_id")).collect()
    assert len(rows) > 50
    assert np.mean([(r["score"] >= quality.THRESHOLD) == r["quality"] for r in rows]) > 0.95


def test_quality_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert {r["score"] for r in got.collect()} == {0.5}
    assert quality.score(none, model).count() == 0


def test_gradient_matches_differences():
    r = np.random.default_rng(3)
    bags = [r.normal(size=(n, quality.FEATURES)) for n in (1, 3, 2)]
    y = np.array([1.0, 0, 1])
    model = quality.fit_arrays([b.astype(np.float32) for b in bags], y, rounds=3)
    x, first, count = np.concatenate(bags), np.array([0, 1, 4]), np.array([1, 3, 2])

    def loss():
        logit = model._forward(x, first, count)[-1]
        return np.mean(np.log1p(np.exp(-logit)) * y + np.log1p(np.exp(logit)) * (1 - y))

    slopes = model.gradient(x, first, count, y)
    for name in quality.Model.NAMES:
        part = model.parts[name].reshape(-1)
        i = r.integers(len(part))
        kept = part[i]
        part[i] = kept + 1e-5
        up = loss()
        part[i] = kept - 1e-5
        down = loss()
        part[i] = kept
        assert slopes[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# 10 --------------------------------------------------------------------------
def test_rake(spark):
    r = random.Random(5)
    rows = [(s, g, t, float(r.randint(1, 90))) for s in "abc" for g in "xy" for t in range(3)] + [("d", "x", 0, 0.0), ("e", "x", 1, 5.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic long, tokens double")
    want = {"source": {"a": 2.0, "b": 1.0, "c": 1.0, "z": 9.0}, "lang": {"x": 0.5, "y": 0.5}, "topic": {0: 0.2, 1: 0.3, 2: 0.5}}
    kinds = {"source": "string", "lang": "string", "topic": "long"}
    targets = {d: spark.createDataFrame(list(t.items()), f"{d} {kinds[d]}, share double") for d, t in want.items()}
    got = mixing.rake(cells, targets, tolerance=1e-6).collect()
    assert len(got) == len(rows)
    assert all(x["weight"] == 0 for x in got if x["source"] in "de")
    for d, t in want.items():
        present = {k: v for k, v in t.items() if k != "z"}
        for k, v in present.items():
            assert sum(x["weight"] for x in got if x[d] == k) == pytest.approx(v / sum(present.values()), rel=1e-4)


def test_mix(docs, none):
    rows = mixing.measured(docs)
    powers = {"source": 0.5, "lang": 0.5, "topic": 1.0}
    got = mixing.probabilities(rows, powers=powers, budget=0.4).collect()
    assert len(got) == len(ROWS) and all(0 <= r["probability"] <= 1 for r in got)
    assert {r["id"]: r["tokens"] for r in got} == {r[0]: len(encoder().ids(r[1])) for r in ROWS}
    kept = mixing.mix(docs, powers=powers, budget=0.4)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["id"] for r in got if r["kept"]}
    assert mixing.mix(none, powers=powers, budget=0.4).count() == 0


@pytest.mark.parametrize("budget", [0.5, None])
def test_kept_tokens_meet_the_targets(spark, budget):
    # A large source beside small ones, and cells that are too small for their weights.
    r = random.Random(6)
    rows = [(i, s, g, t, r.randint(5, 15) * (9 if s == "s0" else 1) * (9 if t else 1) * (4 if g == "en" else 1))
            for i, (s, g, t) in enumerate(itertools.product([f"s{k}" for k in range(9)], ["en", "de"], range(4)))]
    df = spark.createDataFrame(rows, "id long, source string, lang string, topic long, tokens long")
    powers = {"source": 0.6, "lang": 0.6, "topic": 0.7}
    got = mixing.probabilities(df, powers=powers, budget=budget).collect()
    kept = sum(x["tokens"] * x["probability"] for x in got)
    total = sum(x[4] for x in rows)
    assert kept == pytest.approx(0.5 * total, rel=0.01) if budget else kept > 0.1 * total
    assert max(x["probability"] for x in got) == pytest.approx(1)
    for d, power in powers.items():
        sizes = {v: sum(x["tokens"] for x in got if x[d] == v) for v in {x[d] for x in got}}
        want = {v: n ** power / sum(m ** power for m in sizes.values()) for v, n in sizes.items()}
        for v, share in want.items():
            assert sum(x["tokens"] * x["probability"] for x in got if x[d] == v) / kept == pytest.approx(share, rel=0.015)


def test_a_source_too_small_for_its_target_is_taken_whole(spark):
    rows = [(0, "a", "", 0, 10), (1, "b", "", 0, 400), (2, "c", "", 0, 600)]
    df = spark.createDataFrame(rows, "id long, source string, lang string, topic long, tokens long")
    got = {x["source"]: x["probability"] * x["tokens"] for x in mixing.probabilities(
        df, powers={"source": 0.0, "lang": 1.0, "topic": 1.0}, budget=0.5).collect()}
    assert got == {"a": pytest.approx(10), "b": pytest.approx(247.5, rel=0.01), "c": pytest.approx(247.5, rel=0.01)}


# All ---------------------------------------------------------------------------
def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    more = {"n_words": 7, "removed": "r", "__gone": 1, "__score": 0.9, "fp": 2, "id": "x", "component": 3,
            "chunk": 4, "kind": "k", "weight": 0.5, "kept": True, "topic": "t", "score": 0.1, "grp": 5}
    ddl = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, removed string, "
           "__gone long, __score double, fp long, id string, component long, chunk long, kind string, "
           "weight double, kept boolean, topic string, score double, grp long")
    text = spark.read.parquet(f"{folder}/documents.parquet").join(
        spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1"), "doc_id").orderBy(
        "doc_id").first()["text"]
    rows = [(i, t, "en", "s", None, *more.values()) for i, t in (
        (1, text), (2, text), (2, text), (None, text), (None, None), (4, ""), (5, None), (6, " \n\t"),
        (8, " ".join(f"w{i % 9973}" for i in range(60_000))))]
    some, none = spark.createDataFrame(rows, ddl), spark.createDataFrame([], ddl)
    kept = {"near_dedup": [None, None, 1, 4, 8], "substring_dedup": [r[0] for r in rows]}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, some, folder)
        assert stage(spark, none, folder).count() == 0
        if name == "packing":
            ids = {encoder().ids(t).__len__() + 1 for _, t, *_ in rows}
            assert {r["doc_tokens"] for r in got.collect()} == ids
            continue
        assert got.columns == some.columns
        found = got.collect()
        assert all(r[c] == v for r in found for c, v in more.items())
        if name == "quality":
            assert sum(r["text"] == text for r in found) == 4
        if name in kept:
            assert sorted(map(str, (r["doc_id"] for r in found))) == sorted(map(str, kept[name]))
        if name == "substring_dedup":
            assert sorted(_words(r["text"]) == [] for r in found if r["doc_id"] in (None, 1, 2)) == [False] + [True] * 4


def test_queries_and_pipeline(spark):
    import corpus_pipeline
    from millrace.llm import queries
    from tests.compare import compare_frame, oracle

    folder = "/root/testdata/sf0.001"
    con = oracle(folder)
    assert [n.split("_")[0] for n in queries.all_queries()] == [f"op{i}" for i in range(1, 11)]
    for name in queries.all_oracles():
        assert compare_frame(queries.all_queries()[name](spark, folder), con, name) is None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert sorted(after.dtypes) == sorted(docs.dtypes)
        docs = after.cache()
        assert 0 < docs.count() <= 200
    pieces = corpus_pipeline.run(spark, folder).collect()
    _check_packing(pieces, {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)
