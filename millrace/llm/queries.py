"""The operators' queries over the given tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import (
    html_crf, lemp, lengths, mixcoder, mixing, mtree, multi_index, order_minhash, packing, quality, simhash,
    substring, warc,
)
from millrace.llm.common import session, table
from millrace.session import cut_lineage, work_path

_WHITE = r"[\x20\x09-\x0D]+"


# Production parameters of the mixture: marginals are flattened towards equal shares.
MIX_POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.5}
MIX_BUDGET = 0.5


def op1_html_crf(spark, folder):
    made = html_crf.extract(table(spark, folder, "pages"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_order_minhash(spark, folder):
    made = order_minhash.compare_with_next(table(spark, folder, "documents"))
    return made.withColumnRenamed("id", "doc_id")


def op3_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


def op4_token_counts(spark, folder):
    found = lengths.encoded_lengths(table(spark, folder, "documents"))
    return lengths.context_limits(lengths.histogram(found))


def op5_warc(spark, folder):
    path = work_path(spark, "warc")
    warc.write_warc(warc.revisits(table(spark, folder, "pages")), path)
    chunks = warc.read_chunks(session(spark), path, payloads=False)
    return chunks.where("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


def op6_substring_dedup(spark, folder):
    made = substring.cut_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    line = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _WHITE, " "))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(line, 256).alias("kept_sha256"))


def op7_mtree(spark, folder):
    return mtree.top_k(table(spark, folder, "embeddings"))


def op8_simhash(spark, folder):
    made = simhash.near_duplicates(table(spark, folder, "documents"))
    return made.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def op9_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_mixing(spark, folder):
    rows = mixing.measured(table(spark, folder, "documents"))
    drawn = mixing.probabilities(rows, powers=MIX_POWERS, budget=MIX_BUDGET)
    return drawn.withColumnRenamed("id", "doc_id").select(
        "doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "kept")


def op11_multi_index(spark, folder):
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.hard_negatives(rows.withColumn("label", moved))


def op12_lemp(spark, folder):
    return lemp.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_mixcoder(spark, folder):
    path = work_path(spark, "ids")
    mixcoder.write_ids(table(spark, folder, "documents"), path)
    found = cut_lineage(mixcoder.read_ids(session(spark), path))
    return mixcoder.with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


_OP5 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), g AS (
  SELECT *, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS kept FROM p
)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND kept <> page_id THEN kept END AS refers_to
FROM g
"""

_OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r
  FROM s WHERE same
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
  WHERE r <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

_OP6 = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM starts
), earliest AS (
  SELECT g, min(doc_id) AS first_doc FROM windows GROUP BY g
), flagged AS (
  SELECT w.doc_id, w.i FROM windows w JOIN earliest e ON w.g = e.g WHERE e.first_doc < w.doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS js FROM flagged, range(13) AS r(k) GROUP BY doc_id
)
SELECT d.doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed,
  sha256(array_to_string(
    CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(js, j)) END, ' '
  )) AS kept_sha256
FROM docs d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS ts
  FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t
  FROM benchmark
), qt AS (
  SELECT item_id, t, count(*) AS c FROM q GROUP BY item_id, t
), c AS (
  SELECT count(*) AS docs, sum(len(ts))::HUGEINT AS total FROM d WHERE len(ts) > 0
), w AS (
  SELECT r, doc_id, len(ts)::HUGEINT AS n, unnest(ts) AS t FROM d
), tf AS (
  SELECT r, doc_id, n, t, count(*)::HUGEINT AS tf FROM w WHERE t IN (SELECT t FROM qt) GROUP BY r, doc_id, n, t
), df AS (
  SELECT t, count(*) AS df FROM tf GROUP BY t
), s AS (
  SELECT qt.item_id, tf.r, tf.doc_id, sum(qt.c
    * CAST(floor(1000 * ln(CAST(2 * c.docs + 2 AS DOUBLE) / (2 * df.df + 1))) AS HUGEINT)
    * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * c.docs) // c.total)))) AS score
  FROM tf JOIN df USING (t) JOIN qt USING (t) CROSS JOIN c
  GROUP BY qt.item_id, tf.r, tf.doc_id
), k AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 20
"""

QUERIES = {
    "op1_html_crf": (op1_html_crf, None),
    "op2_order_minhash": (op2_order_minhash, None),
    "op3_packing": (op3_packing, None),
    "op4_token_counts": (op4_token_counts, None),
    "op5_warc": (op5_warc, _OP5),
    "op6_substring_dedup": (op6_substring_dedup, _OP6),
    "op7_mtree": (op7_mtree, _OP7),
    "op8_simhash": (op8_simhash, None),
    "op9_quality": (op9_quality, None),
    "op10_mixing": (op10_mixing, None),
    "op11_multi_index": (op11_multi_index, _OP11),
    "op12_lemp": (op12_lemp, _OP12),
    "op13_mixcoder": (op13_mixcoder, None),
}


def all_queries():
    return {name: run for name, (run, _) in QUERIES.items()}


def all_oracles():
    return {name: text.strip() for name, (_, text) in QUERIES.items() if text}
