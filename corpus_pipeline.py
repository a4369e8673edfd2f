"""A corpus as training sequences: quality, near-duplicates, repeats, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the next one reads
what it wrote. All but the last return the columns of ``docs``, whatever further columns
there are and however they are named.

Rows that are odd: the classifier scores null and empty texts like any other; texts
without words are near-duplicates of each other; rows without an id are kept where ids
decide, and packed; of rows that repeat an id, all stay or all go. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import mixing, packing, quality, simhash, substring
from millrace.session import work_path


def _free(name, docs):
    """``name``, made longer until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def good_quality(spark, docs, sf_dir):
    """Documents that the classifier accepts; it is fitted on these documents' labels."""
    name = _free("__score", docs)
    model = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    scored = quality.score(docs, model, score_column=name)
    return scored.where(F.col(name) >= quality.THRESHOLD).drop(name)


def one_of_each(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def without_repeats(spark, docs, sf_dir):
    """Texts without passages that an earlier document has."""
    clashing = {c: _free(c, docs) for c in docs.columns if c in substring.ADDED}
    cut = substring.cut_repeats(docs.withColumnsRenamed(clashing)).drop(*substring.ADDED)
    cut = cut.withColumnsRenamed({new: old for old, new in clashing.items()}).select(docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


# All marginals a little flatter than they are, in a sample of this share of the tokens.
# A source, language or topic with fewer tokens than its share is taken whole and the others
# divide what it lacks, so the sample does not depend on the rarest of them.
MIX_POWERS = {"source": 0.9, "lang": 0.95, "topic": 0.95}
MIX_BUDGET = 0.95


def mixed(spark, docs, sf_dir):
    """A sample whose sources, languages and topics have their target weights."""
    return mixing.mix(docs, powers=MIX_POWERS, budget=MIX_BUDGET)


def packed(spark, docs, sf_dir):
    """Token sequences of at most 2,048."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each one written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
