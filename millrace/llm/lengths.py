"""Token counts: the exact histogram of encoded lengths and what follows from it.

Documents are counted by encoded length, a shuffle of one row per length and task.
Suffix sums over the histogram then answer, for any context limit, how many documents
and tokens fit, how many are longer, how many tokens remain when longer documents are
cut, and which quantile the limit is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import NAME, encoder
from millrace.session import cut_lineage

LIMITS = tuple(1 << k for k in range(7, 18))
# Lengths of one slice of the suffix sums.
_SLICE = 64


def encoded_lengths(docs: DataFrame, text_column: str = "text", tokenizer: str = NAME) -> DataFrame:
    """One row per document: ``length``, the number of its token ids (null: 0)."""

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            counts = [len(encode.ids(text.as_py())) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["length"])

    return docs.select(F.col(text_column).alias("text")).mapInArrow(run, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("length").agg(F.count("*").alias("docs"))


def context_limits(counts: DataFrame, limits=LIMITS) -> DataFrame:
    """For every length that occurs and every limit given: ``context_limit``,
    ``documents`` of exactly this length, ``documents_longer``, ``tokens_longer``,
    ``documents_within``, ``tokens_within``, ``truncated_tokens`` (all documents cut to
    the limit), ``quantile`` (share of documents within).

    An empty histogram gives the limits with zeros and a null quantile. Suffix sums go
    in two levels, inside slices of 64 lengths and over one row per slice, so no
    task sees all lengths.
    """
    spark = counts.sparkSession
    asked = spark.createDataFrame([(int(n), 0) for n in limits], "length long, docs long")
    # Read twice below; the documents behind it are to be encoded once.
    rows = cut_lineage(counts.unionByName(asked).groupBy("length").agg(F.sum("docs").alias("docs"))
                       .withColumn("slice", F.floor(F.col("length") / _SLICE)))
    inside = Window.partitionBy("slice").orderBy(F.desc("length")).rowsBetween(
        Window.unboundedPreceding, -1)
    tokens = F.col("docs") * F.col("length")
    near = rows.select(
        "*", F.coalesce(F.sum("docs").over(inside), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum(tokens).over(inside), F.lit(0)).alias("tokens_after"))
    slices = rows.groupBy("slice").agg(
        F.sum("docs").alias("docs"), F.sum(tokens).alias("tokens"))
    later = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    far = slices.select(
        "slice", F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_far"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_far"),
        F.sum("docs").over(whole).alias("docs_all"), F.sum("tokens").over(whole).alias("tokens_all"))
    longer = F.col("docs_after") + F.col("docs_far")
    tokens_longer = F.col("tokens_after") + F.col("tokens_far")
    return near.join(far, "slice").select(
        F.col("length").alias("context_limit"), F.col("docs").alias("documents"),
        longer.alias("documents_longer"), tokens_longer.alias("tokens_longer"),
        (F.col("docs_all") - longer).alias("documents_within"),
        (F.col("tokens_all") - tokens_longer).alias("tokens_within"),
        (F.col("tokens_all") - tokens_longer + longer * F.col("length")).alias("truncated_tokens"),
        F.expr("try_divide(docs_all - docs_after - docs_far, docs_all)").alias("quantile"))


def quantile(counts: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least this share of documents is within;
    null without documents."""
    return context_limits(counts, ()).where(F.col("quantile") >= share).agg(
        F.min("context_limit").alias("length"))
