"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic by their tokens. The
cells' weights are raked: scaled to each marginal in turn until all agree with their
targets, while no cell asks for more tokens than it has. A document is then kept with the
probability that its cell's weight asks for, decided by a hash of its id.

Topics are sides of random hyperplanes through the middle of the corpus, over words
weighted by their rarity: texts of like vocabulary share them. They have no names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm.bytesops import ByteHash, slices, spans, words
from millrace.llm.tokens import NAME, encoder
from millrace.session import cut_lineage

DIMENSIONS = ("source", "lang", "topic")
TOPIC_BITS = 3
# Buckets in which the rarity of words is counted.
RARITY = 4096
ROUNDS = 25
TOLERANCE = 0.01


def _hashed(column):
    """Row, rarity bucket and hash of every word."""
    data, offsets = spans(column)
    starts, ends, row = words(data, offsets)
    hashes = ByteHash(31).ranges(data, starts, ends)
    return row, (hashes >> np.uint64(40) & np.uint64(RARITY - 1)).astype(np.int64), hashes


def _signs(hashes, bit):
    return (hashes >> np.uint64(bit + 8) & np.uint64(1)).astype(np.float64) * 2 - 1


class Topics:
    """Random hyperplanes through the middle of a corpus: bit b of a topic tells on which
    side of the b-th one a text lies. A word moves a text by its sign in b, drawn by hash,
    times the rarity of its bucket; ``centre`` is the corpus's mean move per word."""

    def __init__(self, documents: int, having: np.ndarray, moved: np.ndarray):
        """How many documents there are, in how many each bucket occurs, and the sum of
        its words' signs for each bit; the last row counts the words themselves."""
        self.rarity = np.log((1 + documents) / (1 + having))
        total = moved[-1].sum()
        self.centre = moved[:-1] @ self.rarity / total if total else np.zeros(len(moved) - 1)

    def of(self, column) -> np.ndarray:
        """A topic number for each text; texts without words have topic 0."""
        row, bucket, hashes = _hashed(column)
        weight, out = self.rarity[bucket], np.zeros(len(column), np.int64)
        for bit, middle in enumerate(self.centre):
            side = np.bincount(row, weight * _signs(hashes, bit) - middle, minlength=len(column))
            out |= (side > 0).astype(np.int64) << bit
        return out


def topics_of(docs: DataFrame, text_column: str = "text", bits: int = TOPIC_BITS) -> Topics:
    """The topics of a corpus, from counts over all its words in RARITY buckets."""

    def run(batches):
        documents, having, moved = 0, np.zeros(RARITY), np.zeros((bits + 1, RARITY))
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket, hashes = _hashed(part.column(0))
                documents += part.num_rows
                seen = np.unique(row * RARITY + bucket)
                having += np.bincount(seen % RARITY, minlength=RARITY)
                for bit in range(bits):
                    moved[bit] += np.bincount(bucket, _signs(hashes, bit), minlength=RARITY)
                moved[bits] += np.bincount(bucket, minlength=RARITY)
        made = [np.arange(RARITY), np.full(RARITY, documents), having.astype(np.int64), *moved.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=names)

    names = ["bucket", "documents", "having", *(f"m{b}" for b in range(bits + 1))]
    counted = docs.select(F.col(text_column).alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    rows = counted.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names[1:])).orderBy("bucket").collect()
    table = np.array([list(r) for r in rows], float).reshape(-1, len(names)).T
    if not table.size:
        return Topics(0, np.zeros(RARITY), np.zeros((bits + 1, RARITY)))
    return Topics(int(table[1, 0]), table[2], table[3:])


def measured(docs: DataFrame, *, id_column="doc_id", text_column="text", tokenizer: str = NAME) -> DataFrame:
    """``id``, ``source``, ``lang``, ``topic``, ``tokens`` of every row, written once.
    Null sources and languages become the empty string; null texts have no tokens."""
    topics = topics_of(docs, text_column)

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column(3)
                counts = [len(encode.ids(t.as_py())) for t in text]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(topics.of(text)), pa.array(counts, pa.int64())],
                    names=["id", "source", "lang", "topic", "tokens"])

    chosen = docs.select(
        F.col(id_column).alias("id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                                        for c in ("source", "lang")), F.col(text_column).alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    return cut_lineage(chosen.mapInArrow(
        run, f"id {kind}, source string, lang string, topic long, tokens long"))


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens"))


def flattened(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of a marginal: its tokens to a power below one, as shares; a power
    of zero asks for equal shares."""
    return cells.where("tokens > 0").groupBy(dimension).agg(F.sum("tokens").alias("t")).select(
        dimension, F.pow("t", F.lit(power)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], *, total: float | None = None,
         rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``weight``: shares of all tokens whose marginals are the targets'.

    A target has a dimension's values and their ``share``; shares are scaled to add up
    to one over the values that have tokens. Cells without tokens or without a share in
    a target get weight 0. With a ``total``, the tokens that a sample is to have, no cell's
    weight asks for more than its tokens: full cells stay at that and the others make up
    for them. A value with too few tokens for its share is then wanted whole, and the other
    values divide the rest by their shares. Rounds end when all marginals are within
    ``tolerance`` of the targets, when they come no nearer, or after ``rounds``; targets
    that contradict the zeros or the sizes of the cells come as near as that. Every step is written to the shared
    folder. No cells give no rows.
    """
    known = cells.where("tokens > 0")
    most = F.col("tokens") / F.lit(float(total)) if total else F.lit(float("inf"))
    wanted = {}
    for d, target in targets.items():
        room = known.groupBy(d).agg(F.sum(most).alias("most"))
        wanted[d] = _reachable(cut_lineage(_normal(target.join(room.hint("merge"), d))))
    # Weights are tokens times a factor for each dimension; only factors change.
    factors: dict[str, DataFrame] = {}

    def weighted(rows, without=None):
        share = F.col("tokens")
        for d in factors.keys() - {without}:
            # Many small plans follow each other; broadcasts would pile up on the driver.
            rows = rows.join(factors[d].hint("merge"), d, "left")
            share = share * F.coalesce(F.col(f"__{d}"), F.lit(0.0))
        return rows.withColumn("weight", share)

    worst, still = float("inf"), 0
    for _ in range(rounds):
        before, worst = worst, 0.0
        for d, target in wanted.items():
            rows = weighted(known, d)
            if d in factors:
                rows = rows.join(factors[d].hint("merge"), d, "left").withColumn(
                    "__old", F.coalesce(F.col(f"__{d}"), F.lit(0.0)))
            else:
                rows = rows.withColumn("__old", F.lit(0.0))
            full = F.col("weight") * F.col("__old") >= most
            sums = rows.groupBy(d).agg(
                F.first("__old").alias("__old"), F.sum("weight").alias("__sum"),
                F.sum(F.when(full, most).otherwise(0.0)).alias("__full"),
                F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("__free"))
            # The free cells take what the full ones leave; if that is nothing, too many are
            # full, and the factor starts again from none. All full and wanted so is settled.
            new = (F.when(F.expr("__free = 0 AND __full > 0 AND share >= __full * (1 - 1e-9)"), F.col("__old"))
                   .when(F.expr("__free > 0 AND share > __full"), F.expr("(share - __full) / __free"))
                   .otherwise(F.expr("try_divide(share, __sum)")))
            made = target.join(sums.hint("merge"), d).withColumn("__new", F.coalesce(new, F.lit(0.0)))
            step = Observation()
            off = F.max(F.abs(F.expr("try_divide(__full + __free * __old, share)") - 1))
            made = made.observe(step, off.alias("off")).select(d, F.col("__new").alias(f"__{d}"))
            factors[d] = cut_lineage(made)
            worst = max(worst, step.get["off"] or 0.0)
        still = still + 1 if abs(worst - before) <= tolerance / 10 else 0
        if worst <= tolerance or still == 2:
            break
    made = weighted(cells).withColumn("weight", F.least(F.col("weight"), most))
    return cut_lineage(made.drop(*(f"__{d}" for d in factors)))


def _normal(target: DataFrame) -> DataFrame:
    total = target.agg(F.sum("share")).first()[0] or 1.0
    return target.withColumn("share", F.col("share") / total)


def _reachable(target: DataFrame) -> DataFrame:
    """Shares of at most ``most``: values that are to have more have that, and what they
    lack goes to the others in proportion to their shares."""
    scale = 1.0
    while True:
        over = F.col("share") * scale >= F.col("most")
        full, rest = target.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)),
                                F.sum(F.when(over, 0.0).otherwise(F.col("share")))).first()
        if not rest or (1 - full) / rest <= scale * (1 + 1e-9):
            break
        scale = (1 - full) / rest
    return cut_lineage(target.withColumn("share", F.least("most", F.col("share") * scale)).drop("most"))


def probabilities(rows: DataFrame, *, powers: dict[str, float], budget: float | None, seed: int = 17,
                  rounds: int = ROUNDS) -> DataFrame:
    """``rows`` of :func:`measured` with ``weight`` of their cell, ``probability`` and
    ``kept``.

    The sample has ``budget`` times the tokens of all rows and the targets' marginals; a
    value with fewer tokens than its target is taken whole (probability 1), and the others
    share what it lacks. Without a budget the sample is as large as it can be with every
    cell at its share and all targets met. Rows with equal ids share one
    decision; rows without an id share one as well. Documents without tokens in a cell
    without tokens have probability 0.
    """
    cells = cut_lineage(cells_of(rows))
    total = None if budget is None else budget * (cells.agg(F.sum("tokens")).first()[0] or 0.0)
    raked = rake(cells, {d: flattened(cells, d, p) for d, p in powers.items()}, total=total, rounds=rounds)
    if total is None:
        total = raked.where("weight > 0").agg(F.min(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    share = F.coalesce(F.expr("try_divide(weight, tokens)"), F.lit(0.0)) * F.lit(total)
    known = raked.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), share).alias("probability"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53))
    return rows.join(known, list(DIMENSIONS)).withColumn("kept", draw < F.col("probability"))


def mix(docs: DataFrame, *, powers: dict[str, float], budget: float | None, id_column="doc_id",
        text_column="text", seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, all columns as they are."""
    rows = measured(docs, id_column=id_column, text_column=text_column)
    drawn = probabilities(rows, powers=powers, budget=budget, seed=seed)
    gone = drawn.where(~F.col("kept")).select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_column].eqNullSafe(gone["__gone"]), "left_anti")
