"""The registered queries of this subpackage: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, chat_format, html_extract, jaccard_join, language_id, mixing, pu_quality, quality_rules, token_counts, topk_search
from glossa.llm.common import table


#: Vocabulary files; a parameter of the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), BYTE_BPE, keep=["doc_id"])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.token_counts(docs, PIECE_BPE, keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(language_id.held_out(), F.lit(False))
    bundles = language_id.train(docs.where(~held))
    return language_id.predict(docs.withColumn("held_out", held), bundles, keep=["doc_id", "held_out"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules.apply_rules(table(spark, sf_dir, "documents"), host="source", text="text", keep=["doc_id"])
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    return chat_format.format_digests(told.unionByName(own))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(language_id.held_out(), F.lit(False))
    model, _ = pu_quality.train(docs.where(~held), table(spark, sf_dir, "labels"))
    return pu_quality.score(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_mixing, op3_token_counts, op4_language_id, op5_quality_rules, op6_html_extract, op7_chat_format, op8_jaccard_join, op9_topk_search, op10_pu_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": OP5_SQL, "op7_chat_format": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op9_topk_search": OP9_SQL}


#: \x0B and \x0C are white space between words too.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
),
f AS (
  SELECT w.rid, w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w) w
  LEFT JOIN rep USING (rid)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS x FROM b WHERE source IS NOT NULL GROUP BY source
),
m AS (
  SELECT sum(n) AS docs, count(*) AS hosts, sum(x) / sum(n) AS mean, sum(n * (x / n) * (x / n)) AS sq FROM h
),
p AS (
  SELECT mean, least(greatest(mean * (1 - mean)
    / greatest(greatest(sq / docs - mean * mean, 0) - mean * (1 - mean) * hosts / docs, 1e-9) - 1, 2), 1000) AS s FROM m
),
v AS (SELECT source, (x + s * mean) / (n + s) <= 6e-1 AS ok FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(ok, true) AS kept
FROM b LEFT JOIN v USING (source)
"""

#: What the formatted text must read back as; a control string and the backslashes before it are written 2n + 1 times escaped.
OP7_SQL = r"""
WITH t AS (
  SELECT CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT NULL, -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(k)
),
w AS (
  SELECT *, length('### ') + coalesce(length(regexp_replace(role, '([\\\n:#<?])', '\\\1', 'g')), 1) + length(': ')
    + length(regexp_replace(text, '(\\*)(###|</turn>)', '\1\1\\\2', 'g')) + length(' </turn>') + 1 AS written
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(written) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id, own
"""

#: Rows are documents of their own. All that share a shingle are compared; components by reachability.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s
  FROM d
),
each AS (SELECT rid, len(s) AS n, unnest(s) AS x FROM sets WHERE doc_id IS NOT NULL),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS both_, any_value(a.n) AS na, any_value(b.n) AS nb FROM each a JOIN each b ON a.x = b.x AND a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS (SELECT a, b FROM shared WHERE 100 * both_ >= 85 * (na + nb - both_)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS rid, min(doc_id) AS other FROM reach JOIN sets ON sets.rid = reach.b GROUP BY a),
degree AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN least(doc_id, coalesce(other, doc_id)) END AS component_id, coalesce(n_links, 0) AS n_links
FROM sets LEFT JOIN least USING (rid) LEFT JOIN degree USING (rid)
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
