"""The ten operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import byte_bpe, chat_format, decontamination, ngram_join, pii, pq_dedup, secret_scan, substring_dedup, toxicity, url_filter
from pagewright.llm.common import table

#: The rules that the contract names: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: Conversation -1 of the contract: texts that hold control strings.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.expand(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op8_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.links(table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_spans(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_pq_dedup": op8_pq_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP6_SQL = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(h, p, v) AS (VALUES {_RULES}),
fits AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS n
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE n = 1
"""

OP2_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{TRICKY}'), (-1, 1, 'assistant', '{TRICKY}')
), s AS (
  SELECT *, {len(chat_format.START) + 1 + len(chat_format.END) + 1}
           + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '{chat_format.NEWLINE}')) AS size
  FROM t
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = count(*) OVER (PARTITION BY conv_id) AS last
  FROM s
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE last OR role = 'assistant') AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

#: Words of a text: A-Z lower-cased, runs of other characters than ASCII punctuation, space and control.
_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + 12], ' ') AS said
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), hits AS (
  SELECT p.doc_id, p.k, p.n, v.item
  FROM (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d), (SELECT DISTINCT n FROM windows) WHERE k + n - 1 <= len(w)) p
  JOIN windows v ON v.n = p.n AND v.said = p.said
), marked AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked m ON m.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

_REACH = """edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a), n AS (SELECT a AS id, count(*) AS n_links FROM edges GROUP BY a)"""

OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(said, '|' ORDER BY said)) AS same FROM grams GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM grams x JOIN grams y ON x.said = y.said AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN sizes s ON s.doc_id = p.a JOIN sizes t ON t.doc_id = p.b WHERE 5 * common >= 4 * (s.n + t.n - common)
), {_REACH}
SELECT d.doc_id, coalesce(n.n_links, 0) AS n_links, coalesce(least.component, d.doc_id) AS class_id, coalesce(min(d.doc_id) OVER (PARTITION BY coalesce(same, CAST(d.doc_id AS VARCHAR))), d.doc_id) AS rep_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN n ON n.id = d.doc_id LEFT JOIN least ON least.id = d.doc_id
"""

OP8_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT vec_id, label, x FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM s p JOIN s q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
{_REACH}
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM v LEFT JOIN n ON n.id = vec_id LEFT JOIN least ON least.id = vec_id
"""

ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_chat_format": OP2_SQL, "op4_ngram_join": OP4_SQL, "op8_pq_dedup": OP8_SQL, "op6_url_filter": OP6_SQL}
