"""The mixture does not depend on its rarest cell; topics cut the corpus through its middle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing

FOLDER = "/root/testdata/sf0.001"


def _kept(spark, docs, **how):
    rows = mixing.probabilities(mixing.measured(docs), **how)
    return rows.agg(F.sum(F.col("probability") * F.col("tokens")), F.sum("tokens")).first()


@pytest.mark.parametrize("text", ["x", "a new source with a text of some words"])
def test_one_document_of_a_new_source(spark, text):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = docs.union(spark.createDataFrame([(10**9, text, "new", "new")], docs.schema))
    how = {"powers": corpus_pipeline.MIX_POWERS, "budget": corpus_pipeline.MIX_BUDGET}
    before, total = _kept(spark, docs, **how)
    after, _ = _kept(spark, more, **how)
    assert abs(after / before - 1) < 0.01
    assert before >= 0.9 * corpus_pipeline.MIX_BUDGET * total
    kept = corpus_pipeline.mixed(spark, more.withColumn("n_chars", F.length("text").cast("long")), FOLDER)
    assert kept.where("doc_id = 1000000000").count() == 1


def test_topics_split_every_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.measured(docs).where("tokens > 50").groupBy("topic").agg(F.sum("tokens").alias("n")).collect()
    shares = np.array([r["n"] for r in rows]) / sum(r["n"] for r in rows)
    assert len(rows) == 8 and shares.max() < 0.45


def test_topics_by_brute_force(spark):
    """Counts over the corpus are what a plain loop finds, however the rows are dealt."""
    texts = ["a b a c", "b d", None, "", "e e e f", "a b a c", "z " * 500]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    one, other = mixing.topics_of(docs.coalesce(1)), mixing.topics_of(docs.repartition(4))
    assert np.array_equal(one.rarity, other.rarity) and np.array_equal(one.centre, other.centre)
    import pyarrow as pa

    having, words, moves = {}, 0, np.zeros(3)
    for t in texts:
        for w in set((t or "").split()):
            having[w] = having.get(w, 0) + 1
    for t in texts:
        for w in (t or "").split():
            row, bucket, hashes = mixing._hashed(pa.array([w]))
            rarity = np.log((1 + len(texts)) / (1 + having[w]))
            assert one.rarity[bucket[0]] == rarity
            words += 1
            moves += [rarity * mixing._signs(hashes, b)[0] for b in range(3)]
    assert np.allclose(one.centre, moves / words)
    assert mixing.topics_of(docs.limit(0)).of(pa.array(["a"])).tolist()[0] in range(8)
