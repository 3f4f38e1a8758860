"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversation_repair, line_dedup, mixing, packing, quality_rules, simhash, source_divergence, suffix_dedup, suffix_tree, syncmers, token_files, toxicity
from . import sql as long_sql
from .common import table


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer), end_id=1, capacity=4096)
    return packing.pack_pieces(pieces, capacity=4096)


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    out = token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer), end_id=2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "severity", "toxic")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.audits(conversation_repair.damaged(rows), rows)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergences(table(spark, sf_dir, "documents"))


#: The same from the definition: every two lines that share a half, compared by code points (levenshtein() counts bytes, of which a code point has four at most).
OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, row_number() OVER () AS r, text FROM documents
), x AS (
  SELECT doc_id, r, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM l
), n AS (
  SELECT *, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM x
), f AS (
  SELECT line, length(line) AS n, min((doc_id, no)) AS first FROM n WHERE line <> '' GROUP BY line
), k AS (
  SELECT line, n, first, n AS m, 0 AS e, substr(line, 1, n // 2) AS half FROM f
  UNION ALL SELECT line, n, first, n, 1, right(line, n - n // 2) FROM f
  UNION ALL SELECT line, n, first, n - 1, 0, substr(line, 1, (n - 1) // 2) FROM f
  UNION ALL SELECT line, n, first, n - 1, 1, right(line, n - 1 - (n - 1) // 2) FROM f
), near AS (
  SELECT DISTINCT a.line FROM k a JOIN k b ON a.m = b.m AND a.e = b.e AND a.half = b.half AND b.first < a.first AND abs(a.n - b.n) <= 1
  WHERE levenshtein(a.line, b.line) <= 4 AND (
    a.n = b.n AND len(list_filter(generate_series(1, a.n), lambda i: substr(a.line, i, 1) <> substr(b.line, i, 1))) <= 1
    OR a.n = b.n + 1 AND len(list_filter(generate_series(1, a.n), lambda i: substr(a.line, 1, i - 1) || substr(a.line, i + 1) = b.line)) > 0
    OR b.n = a.n + 1 AND len(list_filter(generate_series(1, b.n), lambda i: substr(b.line, 1, i - 1) || substr(b.line, i + 1) = a.line)) > 0)
), d AS (
  SELECT n.doc_id, n.r, n.no, n.raw, n.line = '' OR (f.first = (n.doc_id, n.no) AND near.line IS NULL) AS keep
  FROM n LEFT JOIN f ON f.line = n.line LEFT JOIN near ON near.line = n.line
)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (NOT keep) AS INTEGER) AS n_removed,
  md5(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (keep), '')) AS kept_md5
FROM d GROUP BY doc_id, r
"""

#: The same term by term: every group with every kept term of its language.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS words FROM documents
), t AS (
  SELECT r, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n, k.n AS lang_n
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), w AS (
  SELECT lang, source, term, n, 1 + CAST((CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s) AS BIGINT) AS p,
    1 + CAST((CAST(1000000000 AS HUGEINT) * (lang_n + 2)) // (sum(lang_n) OVER s + 2 * count(*) OVER s) AS BIGINT) AS q
  FROM c WINDOW s AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM w a JOIN w b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), out AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM w WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM out
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_rules": op12_quality_rules,
    "op13_source_divergence": op13_source_divergence,
    "op9_toxicity": op9_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op1_suffix_tree": op1_suffix_tree,
    "op5_neighbours": op5_neighbours,
    "op10_syncmers": op10_syncmers,
    "op2_packing": op2_packing,
    "op8_token_files": op8_token_files,
    "op7_simhash": op7_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op6_mixing": op6_mixing,
}
ORACLE = {
    "op4_suffix_dedup": long_sql.REPEATS,
    "op3_line_dedup": OP3_SQL,
    "op11_conversation_repair": long_sql.CONVERSATIONS,
    "op12_quality_rules": long_sql.QUALITY,
    "op13_source_divergence": OP13_SQL,
}
