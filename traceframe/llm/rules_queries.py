"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm import rules
from traceframe.llm.registry import query, table

_STOPS = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

RULES_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS lw
  FROM documents
),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)
),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again WHERE c > 1) GROUP BY doc_id
),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter,
         len(list_filter(lw, lambda x: x IN ({_STOPS}))) AS n_stop,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
  FROM base
),
j AS (
  SELECT m.*, coalesce(chars, 0)::BIGINT AS word_chars, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN covered c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 14.0 AND n_symbols / n_words <= 0.25
       AND n_upper / word_chars <= 0.5 AND n_letter / n_words >= 0.6 AND n_stop / n_words >= 0.01
       AND n_dup_lines / n_lines <= 0.5 AND n_ellipsis / n_lines <= 0.5 AS kept
FROM j
"""


@query("op5_quality_rules", RULES_SQL)
def op5_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, directory, "documents").select("doc_id", "text"))
    base = (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *[F.col("q_" + c).alias(c) for c in counts], base.alias("base_failed"), (~base & F.col("kept")).alias("kept")
    )
