"""The near-duplicate stage: recall at its threshold, dense groups, nothing below it."""

import itertools
import random

import pytest

from millrace.llm import simhash


def _components(rows):
    sets = [set(simhash.shingles(t, 5).tolist()) for _, t in rows]
    names = list(range(len(rows)))
    edges = [(i, j) for i, j in itertools.combinations(names, 2)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    changed = True
    while changed:
        changed = False
        for i, j in edges:
            low = min(names[i], names[j])
            changed |= names[i] != low or names[j] != low
            names[i] = names[j] = low
    return dict(enumerate(names)), edges


def _found(spark, rows):
    how = {**simhash.WIDE, "id_column": "doc_id", "text_column": "text"}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r["id"]: r["component"] for r in simhash.similar(frame, **how).collect()}


def test_recall_at_the_threshold(spark):
    """Pairs at a similarity of 0.8, of 70 to 1,000 shingles; the README has the figures."""
    r, rows, kinds = random.Random(1), [], []
    for n in (70, 100, 150, 300, 1000):
        shared = -(-16 * n // 18)
        for _ in range(120):
            words = [f"{r.getrandbits(40):x}" for _ in range(n + 4)]
            other = words[: shared + 4] + [f"{r.getrandbits(40):x}" for _ in range(n - shared)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
            kinds.append(n)
    got = _found(spark, rows)
    assert all(c in (i, i - 1) for i, c in got.items())
    share = {n: sum(got[2 * i] == got[2 * i + 1] for i, k in enumerate(kinds) if k == n) / kinds.count(n) for n in set(kinds)}
    print("recall", share)
    assert min(share.values()) >= 0.97 and sum(share.values()) / len(share) >= 0.98


@pytest.mark.parametrize("changes", [2, 4, 6, 9])
def test_dense_groups(spark, changes):
    """Copies with words changed: linked groups of some hundred, from mostly close to mostly
    below the threshold."""
    r, rows = random.Random(changes), []
    for group in range(3):
        base = [f"{group}x{i}" for i in range(140)]
        for _ in range(90):
            words = list(base)
            for _ in range(r.randint(1, changes)):
                words[r.randrange(len(words))] = f"{r.getrandbits(40):x}"
            rows.append((len(rows), " ".join(words)))
    want, edges = _components(rows)
    got = _found(spark, rows)
    # No link that is not one: every class lies within a true component.
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] == got[j] for i, j in edges) >= 0.99 * len(edges)


def test_keys_with_many_texts_are_cut(spark):
    """Pieces of a key meet like the whole key."""
    r, prints = random.Random(5), []
    for _ in range(60):
        base = [r.getrandbits(63) for _ in range(8)]
        base[0] &= ~0x1FFF
        prints += [(len(prints), base, []), (len(prints) + 1, [base[0], *(x ^ 1 << r.randrange(63) for x in base[1:])], [])]
    frame = spark.createDataFrame(prints, "fp long, bits array<bigint>, few array<bigint>")
    keys = simhash.wide_blocks(8, 5)
    whole, cut = ({tuple(x) for x in simhash.close_links(frame, keys, 47, (63, 78), 4, piece=p).collect()} for p in (10_000, 10))
    assert whole == cut and {(2 * i, 2 * i + 1) for i in range(60)} <= whole
    rooted = frame.selectExpr("*", "fp % 3 AS root")
    whole, cut = ({tuple(x) for x in simhash.apart_pairs(rooted, keys, (63, 78), 4, piece=p).collect()} for p in (10_000, 10))
    assert whole == cut == {(2 * i, 2 * i + 1) for i in range(60)}


def test_links_of_a_large_group_do_not_grow_with_its_square(spark):
    """Prints that are all close and all apart are connected by a few links each."""
    r = random.Random(6)
    base = [r.getrandbits(63) for _ in range(8)]
    for size in (50, 400):
        prints = [(i, [x ^ 1 << r.randrange(63) for x in base], [], i) for i in range(size)]
        frame = spark.createDataFrame(prints, "fp long, bits array<bigint>, few array<bigint>, root long")
        got = {tuple(x) for x in simhash.apart_pairs(frame, [(0, 0)], (63, 78), 4).collect()}
        assert len(got) < 5 * size
        assert {r["node"] for r in simhash.components(spark.createDataFrame(list(got), "a long, b long")).collect()} == set(range(1, size))


@pytest.mark.parametrize("piece_bytes", [1 << 20, 40_000, 3_000])
def test_clusters_are_compared_whole_or_in_pieces(spark, piece_bytes):
    """All links between texts of a cluster that are still apart, and none of another cluster."""
    r, rows = random.Random(7), []
    for cluster in range(2):
        base = [f"x{i}" for i in range(60)]
        for _ in range(40):
            words = list(base)
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = f"{r.getrandbits(40):x}"
            rows.append((len(rows), " ".join(words)))
    rows.append((80, ""))
    _, edges = _components(rows)
    cluster = [i // 40 % 2 for i in range(81)]
    root = [i - i % 3 for i in range(81)]
    wanted = [(i, j) for i, j in edges if cluster[i] == cluster[j] and root[i] != root[j]]
    members = spark.createDataFrame([(i, root[i], cluster[i]) for i in range(81)], "fp long, root long, cluster long")
    texts = spark.createDataFrame(rows, "fp long, text string")
    got = {tuple(x) for x in simhash.linked_within(members, texts, 5, 0.8, piece_bytes).collect()}
    assert got and {(min(x), max(x)) for x in got} <= set(wanted) and (piece_bytes < 1 << 20 or len(got) < 81)

    def classes(links):
        names = list(root)
        for i, j in links:
            names = [names[i] if x == names[j] else x for x in names]
        return {tuple(i for i in range(81) if names[i] == x) for x in names}

    assert classes(got) == classes(wanted)
