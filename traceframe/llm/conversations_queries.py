"""Query of the conversation repair and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.conversations import repair_conversations
from traceframe.llm.registry import query, table

CONVERSATIONS_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
),
hit AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
                                    lambda d, k: xor(d >> 1, 3988292384::BIGINT * (d & 1)))), 4294967295::BIGINT) % 20 AS h
  FROM named
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS again
  FROM hit WHERE h <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), text, again) AS i FROM hurt
),
told AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank)::BIGINT AS blank,
         count_if(NOT blank AND seen)::BIGINT AS duplicate, count_if(NOT blank AND NOT seen AND cut)::BIGINT AS truncated,
         count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n
  FROM told GROUP BY conv_id
),
put(start, state, edits, made) AS (
  VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []),
         (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']),
         (3, 3, '', []), (3, 2, 'I', ['user:'])
),
move(before, after, edit, initial) AS (
  VALUES (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'),
         (0, 2, 'R', NULL), (1, 2, 'R', NULL), (3, 2, 'R', NULL), (2, 3, 'R', NULL),
         (0, 0, 'D', NULL), (1, 1, 'D', NULL), (2, 2, 'D', NULL), (3, 3, 'D', NULL)
),
way AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS made FROM counts
  UNION ALL
  SELECT conv_id, i, state, total, trail, made FROM (
    SELECT w.conv_id, t.i, m.after AS state,
           w.cost + 5 * length(p.edits) + CASE m.edit WHEN 'K' THEN 0 WHEN 'R' THEN 1 ELSE 2 END
             + CASE WHEN t.cut AND m.edit <> 'D' THEN 5 ELSE 0 END AS total,
           w.audit || p.edits || m.edit AS trail,
           w.made || p.made || CASE m.edit WHEN 'K' THEN [t.role || ':' || t.text] WHEN 'D' THEN []::VARCHAR[]
             ELSE [CASE m.after WHEN 2 THEN 'user:' ELSE 'assistant:' END || t.text] END AS made
    FROM way w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
    JOIN put p ON p.start = w.state JOIN move m ON m.before = p.state
    WHERE (m.edit = 'D' OR NOT t.blank AND NOT t.seen) AND (m.initial IS NULL OR m.initial = t.initial)
    QUALIFY row_number() OVER (PARTITION BY w.conv_id, m.after ORDER BY total, trail) = 1
  )
),
ended AS (
  SELECT w.conv_id, w.cost + 5 * length(p.edits) AS cost, w.audit || p.edits AS audit, array_to_string(w.made || p.made, chr(10)) AS said
  FROM way w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n JOIN put p ON p.start = w.state AND p.state IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 5 * length(p.edits), w.audit || p.edits) = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of `rows` after the damage: by the hash of conversation and turn a row goes, loses its text or
    its sentence ends, comes twice or becomes the user's. Null roles and texts, and null parts of the hashed name, are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).cast("int")
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(space("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1)))
    hurt = rows.withColumn("hit", hit).where("hit <> 0")
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query("op13_conversation_repair", CONVERSATIONS_SQL)
def op13_conversation_repair(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    every, found = rows.select("conv_id").distinct(), repair_conversations(damaged(rows))
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, every["conv_id"].eqNullSafe(found["conv_id"]), "left").select(
        every["conv_id"],
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
