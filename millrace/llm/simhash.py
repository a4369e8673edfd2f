"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into ``blocks`` parts. Two fingerprints that differ in at
most ``distance`` bits agree in at least ``blocks - distance`` parts, so they share the
key of some choice of that many parts. Distinct fingerprints meet under every such key,
pairs under a key are verified by their Hamming distance, and of the links of a key
only a spanning forest leaves the task, never all pairs. A key with very many
fingerprints is cut into pieces, and pairs of pieces are compared as tasks of their own.

Texts that share four fifths of their shingles differ in a seventh of their bits, too
many for 64 bits to tell. For those, fingerprints are wider (several lanes of 64 bits)
and every block of 12 or 13 bits is a key: pairs as close as that share one of 40 blocks
with a probability of 0.99, closer ones nearly surely. Short texts have further keys,
their smallest shingle hashes, under which all such pairs meet. What is close by its bits
is a candidate only; the sets of shingles decide.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesops import mix, stream
from millrace.llm.components import components
from millrace.session import collected_cuts, cut_lineage
from millrace.storage import delete

SEED = 42
# Fingerprints under one key that a task compares at once.
PIECE = 2048
# Up to this many under a key are compared by shifts, more by a search.
_FEW = 64
# Rows compared in one go, and links of one key per member before they are thinned.
_ROWS, _LINKS = 16_384, 4
_SHINGLES_AT_ONCE = 1 << 16
# Sets of up to this many shingles have their smallest hashes as keys.
SHORT = 64
# Text of one cluster that a task compares with as much again, and what a text counts besides.
PIECE_BYTES, _TEXT_BYTES = 1 << 20, 500


def fingerprint(text: str | None, words: int, lanes: int = 1) -> np.ndarray:
    """Bits set in more than half of the hashes of the text's word shingles, repeats
    counted, as ``lanes`` unsigned numbers; a text of fewer words is one shingle, one
    without words gives zeros. The first lane takes the hashes as they are."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(lanes, np.uint64)
    line, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    ends = ends[min(words, len(parts)) - 1 :]
    counts = np.zeros((lanes, 64), np.int64)
    digest, turns = xxhash.xxh64_intdigest, stream(SEED, lanes)
    for at in range(0, n, _SHINGLES_AT_ONCE):
        span = slice(at, at + _SHINGLES_AT_ONCE)
        hashes = np.array(
            [digest(line[a:b], SEED) for a, b in zip(starts[span].tolist(), ends[span].tolist())],
            "<u8")
        for lane in range(lanes):
            with np.errstate(over="ignore"):
                own = mix(hashes ^ turns[lane]) if lane else hashes
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[lane] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, words: int, id_column="doc_id", text_column="text",
                 lanes: int = 1) -> DataFrame:
    """``id``, ``fp`` and ``bits`` of every row; null text counts as empty. ``bits`` are
    the lanes as signed longs, ``fp`` is a single lane itself or a hash of several."""

    def run(batches):
        for batch in batches:
            made = np.zeros((batch.num_rows, lanes), np.uint64)
            for i, text in enumerate(batch.column(1)):
                made[i] = fingerprint(text.as_py(), words, lanes)
            name = made[:, 0].copy()
            with np.errstate(over="ignore"):
                for lane in range(1, lanes):
                    name = mix(name * np.uint64(3) + made[:, lane])
            bits = pa.FixedSizeListArray.from_arrays(pa.array(made.view(np.int64).ravel()), lanes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(name.view(np.int64)), bits.cast(pa.list_(pa.int64()))],
                names=["id", "fp", "bits"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, fp long, bits array<bigint>")


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles, rising."""
    import xxhash

    parts = (text or "").encode().lower().split()
    return np.unique(np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), SEED)
         for i in range(max(1, len(parts) - words + 1) if parts else 0)), np.uint64))


def set_prints(docs: DataFrame, words: int, similarity: float, id_column="doc_id",
               text_column="text", lanes: int = 8) -> DataFrame:
    """``id``, ``fp``, ``bits``, ``few`` and ``text`` of every row, from distinct shingles:
    ``fp`` names the set, ``bits`` are its lanes. ``few`` are so many of the smallest hashes
    of a set of SHORT or fewer that sets of at least that similarity share one of them."""

    def run(batches):
        turns = stream(SEED, lanes)
        for batch in batches:
            names, lines, few = [], [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py(), words)
                counts = np.zeros((lanes, 64), np.int64)
                for at in range(0, len(hashes), _SHINGLES_AT_ONCE):
                    part = hashes[at : at + _SHINGLES_AT_ONCE]
                    for lane in range(lanes):
                        with np.errstate(over="ignore"):
                            own = mix(part ^ turns[lane]) if lane else part
                        counts[lane] += np.unpackbits(
                            own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                lines.append(np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view("<i8").ravel())
                names.append(int.from_bytes(blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True))
                n = len(hashes) - ceil(similarity * len(hashes) - 1e-9) + 1
                few.append(hashes[:n].view(np.int64).tolist() if len(hashes) <= SHORT else [])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.int64()), pa.array([x.tolist() for x in lines], kind),
                 pa.array(few, kind), batch.column(1)], names=["id", "fp", "bits", "few", "text"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, fp long, bits array<bigint>, few array<bigint>, text string")


def alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose ``texts`` (``fp``, ``text``, one of each) have sets
    of shingles with at least that Jaccard similarity."""
    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("one")), "a").join(
        texts.select(F.col("fp").alias("b"), F.col("text").alias("other")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3)):
                x, y = shingles(one.as_py(), words), shingles(other.as_py(), words)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(shared) and shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays(
                [batch.column(j).filter(pa.array(keep, pa.bool_())) for j in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "one", "other").mapInArrow(run, "a long, b long")


def linked_within(members: DataFrame, texts: DataFrame, words: int, similarity: float,
                  piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Links ``a, b`` between ``members`` (``fp``, ``root``, ``cluster``) of a cluster with
    different roots whose ``texts`` (``fp``, ``text``, one of each) have sets of shingles
    with at least that Jaccard similarity: enough to connect all such pairs.

    A text goes to its cluster once, not to each of its pairs. A cluster of more than two
    pieces' bytes is cut, and two pieces meet in a task of their own."""
    weight = F.length("text") + _TEXT_BYTES
    known = cut_lineage(members.join(texts, "fp"))
    size = known.groupBy("cluster").agg(F.sum(weight).alias("n"))
    large = cut_lineage(size.where(F.col("n") > 2 * piece_bytes).select(
        "cluster", F.ceil(F.col("n") / piece_bytes).cast("int").alias("g")))
    dealt = known.join(large, "cluster", "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn(
        "p", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = dealt.select("cluster", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"),
                        "p", "fp", "root", "text")
    return rows.groupBy("cluster", "lo", "hi").applyInArrow(
        _linked(words, similarity), "a long, b long").distinct()


def _linked(words, similarity):
    def run(rows: pa.Table) -> pa.Table:
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        names, piece = rows.column("fp").to_numpy(), rows.column("p").to_numpy()
        groups = np.unique(rows.column("root").to_numpy(), return_inverse=True)[1]
        sets = [shingles(t.as_py(), words) for t in rows.column("text")]
        sizes = np.array([len(x) for x in sets])
        ends = np.cumsum(sizes)
        # Which rows have a shingle: ``owner`` from ``first`` on, ``often`` of them.
        _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(token, kind="stable")]
        first = np.cumsum(often) - often
        ones, others = [], []
        for i in range(len(sets) - 1):
            open_ = groups != groups[i]
            open_[: i + 1] = False
            if lo < hi:
                open_ &= piece != piece[i]
            if not open_.any():
                continue
            own = token[ends[i] - sizes[i] : ends[i]]
            n = often[own]
            at = np.arange(n.sum()) + np.repeat(first[own] - np.cumsum(n) + n, n)
            shared = np.bincount(owner[at], minlength=len(sets))
            alike_ = (shared > 0) & (shared >= similarity * (sizes + sizes[i] - shared) - 1e-9)
            for j in np.flatnonzero(open_ & alike_):
                if groups[j] != groups[i]:
                    groups[groups == groups[j]] = groups[i]
                    ones.append(i)
                    others.append(j)
        return pa.table({"a": pa.array(names[ones], pa.int64()), "b": pa.array(names[others], pa.int64())})

    return run


def pigeonholes(blocks: int, distance: int) -> list[tuple[int, int]]:
    """Keys for one lane, as (lane, mask): all choices of the blocks that fingerprints
    within ``distance`` bits must agree in."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [(0, sum(c)) for c in combinations(part, blocks - distance)]


def wide_blocks(lanes: int, blocks: int) -> list[tuple[int, int]]:
    """Keys for several lanes: each of the ``blocks`` parts of every lane."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(lane, ((1 << (b - a)) - 1) << a) for lane in range(lanes) for a, b in zip(edges, edges[1:])]


def links(prints: DataFrame, keys: list[tuple[int, int]], distance: int, lanes: int = 1,
          piece: int = PIECE) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (``fp``, ``bits``) that share a key
    and differ in at most ``distance`` bits: enough of them to connect all such pairs."""
    every = F.array(*[F.struct(F.lit(t).alias("t"), F.col("bits")[lane].bitwiseAND(
        F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for t, (lane, m) in enumerate(keys)])
    met = prints.select("fp", "bits", F.explode(every).alias("x")).select("fp", "bits", "x.*")
    hot = _hot_keys(met.select("t", "k"), piece)
    met = met.withColumn("g", F.lit(1)) if hot is None else met.join(hot, ["t", "k"], "left").withColumn(
        "g", F.coalesce("g", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    dealt = met.withColumn("p", mine).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    order = ["t", "k", "lo", "hi"]
    rows = dealt.select("t", "k", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "fp",
                        *_lanes_of(lanes))
    return rows.repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(
        _compare(distance), "a long, b long").distinct()


def _compare(distance):
    def close(a, b):
        return np.bitwise_count(a ^ b).sum(axis=0, dtype=np.int64) <= distance

    def forest(names, bits):
        """Each fingerprint of one key with a close one found before it."""
        left, out = np.arange(len(names)), []
        while len(left):
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                near = close(bits[:, left], bits[:, front[:1]])
                new = left[near]
                out.append(np.stack([np.full(len(new), names[front[0]]), names[new]], 1))
                front, left = np.concatenate([front[1:], new]), left[~near]
        return out

    def pairs(run_of, names, bits):
        cuts = np.flatnonzero(np.diff(run_of)) + 1
        begin = np.concatenate([[0], cuts])
        size = np.diff(np.concatenate([begin, [len(names)]]))
        small = np.repeat(size <= _FEW, size)
        ones, others = [], []
        for shift in range(1, min(_FEW, len(names))):
            at = np.flatnonzero((run_of[:-shift] == run_of[shift:]) & small[:-shift])
            if not len(at):
                break
            at = at[close(bits[:, at], bits[:, at + shift])]
            ones.append(at)
            others.append(at + shift)
        one, other = (np.concatenate(x) if x else np.zeros(0, int) for x in (ones, others))
        many = np.bincount(run_of[one], minlength=len(size)) > _LINKS * size
        few = ~many[run_of[one]]
        out = [np.stack([names[one[few]], names[other[few]]], 1)]
        for i in np.flatnonzero(many | (size > _FEW)):
            run = slice(begin[i], begin[i] + size[i])
            out += forest(names[run], bits[:, run])
        return out

    def run(batches):
        parts = []
        for batch in _then_none(batches):
            if batch is not None:
                parts.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64)
                                       for c in batch.columns]))
            if not parts or batch is not None and sum(p.shape[1] for p in parts) < _ROWS:
                continue
            held = np.concatenate(parts, axis=1)
            parts = [held]
            if not held.shape[1]:
                continue
            changed = np.any(held[:4, 1:] != held[:4, :-1], axis=0)
            run_of = np.concatenate([[0], np.cumsum(changed)])
            # The last key may go on in the next batch.
            stop = held.shape[1] if batch is None else int(np.searchsorted(run_of, run_of[-1]))
            if not stop:
                continue
            found = pairs(run_of[:stop], held[4, :stop], held[5:, :stop].view(np.uint64))
            parts = [held[:, stop:].copy()]
            edges = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(edges[:, j])) for j in (0, 1)], names=["a", "b"])

    return run


def _hot_keys(keys: DataFrame, piece: int) -> DataFrame | None:
    """Keys of more than ``piece`` fingerprints and the pieces each is cut into; none if
    there are none. Counted without fingerprints, in a table of its own, so that the
    planner knows whether it is small."""
    hot = cut_lineage(keys.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > piece)
                      .withColumn("g", F.ceil(F.col("n") / (piece // 2)).cast("int")).drop("n"))
    return None if hot.isEmpty() else hot


def _lanes_of(n):
    return [F.col("bits")[i].alias(f"lane{i}") for i in range(n)]


def close_links(prints: DataFrame, keys: list[tuple[int, int]], near: int, wide: tuple[int, int], compared: int,
                piece: int = PIECE) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints that share a key, told by their first
    ``compared`` lanes: links within ``near`` bits, enough to connect all such pairs; and
    ``a`` with itself for every fingerprint that has another one within ``wide`` bits: the
    first number for keys of blocks, the second for those of short sets."""
    return _meet(_keyed(prints, keys, piece, [F.col("fp"), *_lanes_of(compared)]), _connect(near, wide))


def apart_pairs(prints: DataFrame, keys: list[tuple[int, int]], wide: tuple[int, int], compared: int,
                piece: int = PIECE) -> DataFrame:
    """Pairs ``a, b`` with different ``root`` that share a key and differ in at most ``wide``
    of the bits of the first ``compared`` lanes: enough to connect all such pairs."""
    return _meet(_keyed(prints, keys, piece, [F.col("fp"), *_lanes_of(compared), F.col("root")]), _apart(wide))


def _keyed(prints, keys, piece, columns):
    """Rows by ``key``: a hash of a key, or of two pieces of one with many fingerprints.
    What a comparison needs travels with it once; keys that share a hash meet for nothing."""
    masked = [F.struct(F.lit(t).alias("t"), F.col("bits")[lane].bitwiseAND(
        F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for t, (lane, m) in enumerate(keys)]
    every = F.concat(F.array(*masked), F.transform(
        "few", lambda k: F.struct(F.lit(len(keys)).alias("t"), k.alias("k"))))
    hot = _hot_keys(prints.select(F.explode(every).alias("x")).select("x.*"), piece)
    met = prints.select(*columns, F.explode(every).alias("x")).select("*", "x.*").drop("x")
    kept = [c for c in met.columns if c not in ("t", "k")]

    def key(*parts):
        # The last bit tells keys of short sets.
        return F.xxhash64(*parts).bitwiseAND(F.lit(-2)) + (F.col("t") == len(keys)).cast("long")

    if hot is None:
        return met.select(key("t", "k").alias("key"), *kept)
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    met = met.join(hot, ["t", "k"], "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn(
        "p", mine).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    pair = key("t", "k", F.least("p", "q"), F.greatest("p", "q"))
    return met.select(F.when(F.col("g") == 1, key("t", "k")).otherwise(pair).alias("key"), *kept)


def _meet(rows, found):
    """``found`` over whole keys, told where each begins, how many rows it has, whether it
    is one of short sets, and all columns but the key."""

    def run(batches):
        parts = []
        for batch in _then_none(batches):
            if batch is not None and batch.num_rows:
                parts.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            if not parts or batch is not None and sum(p.shape[1] for p in parts) < _ROWS:
                continue
            held = np.concatenate(parts, axis=1)
            cuts = np.flatnonzero(held[0, 1:] != held[0, :-1]) + 1
            # The last key may go on in the next batch.
            stop = held.shape[1] if batch is None else int(cuts[-1]) if len(cuts) else 0
            parts = [held[:, stop:].copy()] if stop < held.shape[1] else []
            if stop:
                begin = np.concatenate([[0], cuts[cuts < stop]])
                size = np.diff(np.append(begin, stop))
                edges = found(begin, size, held[0, begin] & 1, held[1:, :stop])
                edges = np.concatenate([np.zeros((0, 2), np.int64), *edges])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(edges[:, j])) for j in (0, 1)], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long").distinct()


def _distances(bits, one, other):
    return np.bitwise_count(bits[:, one] ^ bits[:, other]).sum(axis=0, dtype=np.int64)


def _shifted(size):
    """Pairs of places in the same short run, by their distance in it."""
    owner = np.repeat(np.arange(len(size)), size)
    short = np.repeat(size <= _FEW, size)
    for shift in range(1, int(size[size <= _FEW].max(initial=0))):
        at = np.flatnonzero((owner[:-shift] == owner[shift:]) & short[:-shift])
        yield at, at + shift


def _pairs(names, one, other):
    return np.stack([names[one], names[other]], 1)


def _forest(names, close):
    """Links that connect all close names: each with one found before it."""
    left, out = np.arange(len(names)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = close(front[0], left)
            new = left[near]
            out.append(_pairs(names, np.full(len(new), front[0]), new))
            front, left = np.concatenate([front[1:], new]), left[~near]
    return out


def _thinned(names, size, begin, one, other, forest):
    """Links ``one, other`` of short runs where they are few; else, and of long runs, a ``forest``."""
    owner = np.repeat(np.arange(len(size)), size)
    many = np.bincount(owner[one], minlength=len(size)) > _LINKS * size
    kept = ~many[owner[one]]
    out = [_pairs(names, one[kept], other[kept])]
    for i in np.flatnonzero(many | (size > _FEW)):
        out += forest(i, slice(begin[i], begin[i] + size[i]))
    return out


def _connect(near, wide):
    def found(begin, size, short, held):
        names, bits = held[0], held[1:].view(np.uint64)
        limit = np.repeat(np.array(wide)[short], size)
        doubt, links = np.zeros(len(names), bool), [np.zeros((2, 0), np.int64)]
        for one, other in _shifted(size):
            far = _distances(bits, one, other)
            within = far <= limit[one]
            doubt[one[within]] = doubt[other[within]] = True
            links.append(np.stack([one[far <= near], other[far <= near]]))

        def forest(i, run):
            held, doubtful = bits[:, run], doubt[run]

            def close(at, left):
                far = _distances(held, left, [at])
                within = far <= wide[short[i]]
                doubtful[left[within]] = True
                doubtful[at] |= bool(within.any())
                return far <= near

            return _forest(names[run], close)

        out = _thinned(names, size, begin, *np.concatenate(links, axis=1), forest)
        lone = np.flatnonzero(doubt)
        return [*out, np.unique(_pairs(names, lone, lone), axis=0)]

    return found


def _apart(wide):
    def found(begin, size, short, held):
        names, bits, roots = held[0], held[1:-1].view(np.uint64), held[-1]
        limit, links = np.repeat(np.array(wide)[short], size), [np.zeros((2, 0), np.int64)]
        for one, other in _shifted(size):
            at = np.flatnonzero(roots[one] != roots[other])
            at = at[_distances(bits, one[at], other[at]) <= limit[one[at]]]
            links.append(np.stack([one[at], other[at]]))

        def forest(i, run):
            held, root = bits[:, run], roots[run]

            def close(at, left):
                return (root[left] != root[at]) & (_distances(held, left, [at]) <= wide[short[i]])

            return _forest(names[run], close)

        return _thinned(names, size, begin, *np.concatenate(links, axis=1), forest)

    return found


def _then_none(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                    words: int = 4, distance: int = 4, lanes: int = 1, blocks: int = 6) -> DataFrame:
    """``id``, ``fp`` and ``component``, the smallest id reachable over links, of every
    row of ``docs``.

    Fingerprints link at ``distance`` or fewer differing bits; all such links are found
    with one lane, those that share one of a lane's ``blocks`` with more. Null and empty texts
    have fingerprint zero and link like others. Rows without an id count as members but
    never name a component with other ids; a component of such rows alone is null.
    Repeated rows come back repeated. Further columns are not read; no rows give no rows.
    """
    made = cut_lineage(fingerprints(docs, words, id_column, text_column, lanes))
    first = made.groupBy("fp").agg(F.min("id").alias("first"), F.first("bits").alias("bits"))
    keys = pigeonholes(blocks, distance) if lanes == 1 else wide_blocks(lanes, blocks)
    roots = components(links(first.select("fp", "bits"), keys, distance, lanes))
    rooted = first.join(roots, first.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    return made.join(_classes(cut_lineage(rooted)), "fp").select("id", "fp", "component")


def _classes(rooted: DataFrame) -> DataFrame:
    """``fp`` and ``component`` of rows of ``fp, first, root``. The least ids are a table,
    so both sides of the join are exchanged and a large component can be divided."""
    named = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component")))
    return cut_lineage(rooted.select("fp", "root").join(named, "root").select("fp", "component"))


# Five-word shingles with a Jaccard similarity of 0.8 differ in a share of acos(1.6 / 1.8)
# / pi of the bits, 39 of the 256 of four lanes on average and by chance in 6 more or fewer;
# sets of four and five of them in 48, and 7 more or fewer. ``wide`` misses none of them, by
# four deviations: its first number is for keys of blocks, its second for keys of short sets,
# under which all pairs of short sets meet. ``near`` is for links that are tried first, so
# that a large group is joined before all its pairs are. Keys come from all ``lanes``,
# comparisons use the first ``compared``. What is still apart then is told by all ``lanes``:
# ``apart`` are the same two numbers of 512 bits, by five deviations.
WIDE = {"words": 5, "lanes": 8, "compared": 4, "near": 47, "wide": (63, 78), "apart": (119, 146), "blocks": 5,
        "similarity": 0.8}


def similar(docs: DataFrame, *, id_column: str, text_column: str, words: int, lanes: int, compared: int,
            near: int, wide: tuple[int, int], apart: tuple[int, int], blocks: int, similarity: float) -> DataFrame:
    """Like :func:`near_duplicates`, for texts linked by their sets of shingles: every
    link has at least that Jaccard similarity.

    Candidates come from the bits, in an order that keeps few the texts that are compared:
    first, of the links that connect what is near, one for each text; then those whose ends
    are still apart. At last, texts that have another within ``wide`` and links within
    ``apart`` to texts still apart from them make clusters, and in each cluster all pairs
    still apart are compared, with every text there once. Tables on the way are removed.
    """
    tables: list[str] = []
    with collected_cuts(tables):
        made = cut_lineage(set_prints(docs, words, similarity, id_column, text_column, lanes))
        first = cut_lineage(made.groupBy("fp").agg(
            F.min("id").alias("first"), F.first("bits").alias("bits"), F.first("few").alias("few")))
        keys = wide_blocks(lanes, blocks)
        met = cut_lineage(close_links(first, keys, near, wide, compared))
        edges, doubtful = met.where("a <> b"), cut_lineage(met.where("a = b").select(F.col("a").alias("fp")))
        texts = cut_lineage(made.select("fp", "text").join(doubtful, "fp", "left_semi").dropDuplicates(["fp"]))

        def rooted(links):
            roots = components(links)
            return cut_lineage(doubtful.join(roots, doubtful.fp == roots.node, "left").select(
                "fp", F.coalesce("root", "fp").alias("root")))

        def still_apart(roots):
            a, b = (roots.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
            return cut_lineage(edges.join(a, "a").join(b, "b").where("root_a <> root_b").select("a", "b"))

        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        one = ends.groupBy("a").agg(F.min("b").alias("b")).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        linked = cut_lineage(alike(cut_lineage(one), texts, words, similarity))
        linked = cut_lineage(linked.unionByName(alike(still_apart(rooted(linked)), texts, words, similarity)))
        left = rooted(linked)
        far = cut_lineage(apart_pairs(first.join(left, "fp"), keys, apart, lanes))
        apart_ones = far.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        clusters = components(far).select(F.col("node").alias("fp"), F.col("root").alias("cluster"))
        members = left.join(apart_ones, "fp").join(clusters, "fp", "left").select(
            "fp", "root", F.coalesce("cluster", "fp").alias("cluster"))
        within = cut_lineage(linked_within(members, texts, words, similarity))
        roots = components(linked.unionByName(within))
        named = first.select("fp", "first").join(roots, first.fp == roots.node, "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root"))
        classes = _classes(cut_lineage(named))
    whole = cut_lineage(made.select("id", "fp").join(classes, "fp").select("id", "fp", "component"))
    for path in tables:
        delete(docs.sparkSession, path)
    return whole


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
             **how) -> DataFrame:
    """The rows of ``docs`` that name their component: one document of each group, the
    one with the smallest id; texts are linked at a Jaccard similarity of 0.8 or more unless
    ``how`` says otherwise. Rows without an id are kept, since nothing tells them apart;
    of rows that repeat an id, all stay or all go."""
    found = similar(docs, id_column=id_column, text_column=text_column, **{**WIDE, **how})
    gone = found.where("id <> component").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_column] == gone["__gone"], "left_anti")
