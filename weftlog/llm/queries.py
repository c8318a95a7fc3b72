"""The queries of this subpackage, over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, linededup, media, mixing, ngramjoin, quality, secrets, tokens, urls
from .base import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), decontam.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = r"\### Assistant: </turn> ok"
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    return chat.digest_conversations(chat.format_turns(own.unionByName(more)))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secrets.count_of(F.col("base_spans"), k).alias(f"n_{k}") for k, *_ in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"), secrets.joined(F.col("secret_spans")).alias("spans"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of each document, as a digest and a length."""
    left = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "n_lines", "n_removed", "emptied", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


# Host, path and verdict of each rule.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_chat_format, op3_secrets, op4_matroska, op5_line_dedup, op6_mixing, op7_quality, op8_token_counts, op9_url_filter, op10_ngram_join)}

_OP1_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, len(w) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark) t
  WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, least(n, 10) AS size, array_to_string(w[i : i + least(n, 10) - 1], ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, n - least(n, 10) + 2)) AS i FROM item_words) t),
doc_words AS (
  SELECT doc_id, w, len(w) AS n FROM (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents) t),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, n - size + 2)) AS i FROM doc_words, (SELECT DISTINCT size FROM windows) s WHERE n >= size) t),
hits AS (
  SELECT d.doc_id, d.i, d.size, x.item FROM doc_windows d JOIN windows x ON d.size = x.size AND d.win = x.win),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) t GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) t GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""

_OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length('### : ') + length(role) + length(' </turn>') + 1 + length(text)
    + len(list_filter(range(1, length(text) + 1), lambda i: text[i] = '\' OR text[i : i + 2] = '###' OR text[i : i + 6] = '</turn>')) AS chars FROM turns)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT c.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY c.page_id)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM cut c LEFT JOIN fits f USING (page_id)
"""

_OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM words) t),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM grams GROUP BY doc_id),
classes AS (SELECT k, min(doc_id) AS rep FROM sets GROUP BY k),
own AS (SELECT g.doc_id, g.g, s.n FROM grams g JOIN classes c ON g.doc_id = c.rep JOIN sizes s USING (doc_id)),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM own a JOIN own b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 GROUP BY a.doc_id, b.doc_id),
half AS (SELECT a, b FROM shared WHERE 100 * common >= 90 * (na + nb - common)),
links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comps AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN sets t USING (doc_id) LEFT JOIN classes c USING (k) LEFT JOIN comps m ON m.a = c.rep
"""

SQL = {"op1_decontamination": _OP1_SQL, "op2_chat_format": _OP2_SQL, "op9_url_filter": _OP9_SQL, "op10_ngram_join": _OP10_SQL}
