"""Queries over words, banks and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions import text as X
from traceframe.functions.ordered import dense_position
from traceframe.operators import words as Wd
from traceframe.plans import views as V
from traceframe.plans.registry import query


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


REG = "reg AS (SELECT unnest([" + _list(r[0] for r in X.registry_rows()) + "]) AS text, unnest([" + _list(r[1] for r in X.registry_rows()) + "]) AS key, unnest([" + ", ".join(str(r[2]).lower() for r in X.registry_rows()) + "]) AS ligature, unnest([" + ", ".join(str(r[3]).lower() for r in X.registry_rows()) + "]) AS joins)"

SHAPE = REG + r""",
tk0 AS (SELECT word, toks, unnest(range(1, len(toks) + 1)) AS i FROM (SELECT word, regexp_extract_all(word, 'ch|ck|tz|qu|[sſ]t|ß|[sſ]\|?|\||.') AS toks FROM word)),
tk1 AS (SELECT word, i, replace(toks[i], '|', '') AS text, toks[i] LIKE '%|' AS rnd FROM tk0 WHERE toks[i] <> '|'),
tk2 AS (SELECT t.*, r.key, coalesce(r.ligature, false) AS ligature, CASE WHEN t.text IN ('s', 'ſ') THEN true ELSE coalesce(r.joins, false) END AS joins FROM tk1 t LEFT JOIN reg r USING (text)),
tk3 AS (SELECT *, CASE WHEN lag(joins) OVER (PARTITION BY word ORDER BY i) <> joins THEN 1 ELSE 0 END AS cut FROM tk2),
tk4 AS (SELECT *, sum(cut) OVER (PARTITION BY word ORDER BY i) AS run FROM tk3),
tk5 AS (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY i) AS at_, count(*) OVER (PARTITION BY word, run) AS of_ FROM tk4),
tk6 AS (SELECT *, CASE WHEN at_ = 1 THEN 'initial' WHEN at_ = of_ THEN 'final' ELSE 'medial' END AS place FROM tk5),
tok AS (SELECT word, i, text, ligature, joins, CASE WHEN text IN ('s', 'ſ') THEN CASE WHEN rnd OR place = 'final' THEN 's' ELSE 'longs' END ELSE key END AS key,
  CASE WHEN text IN ('s', 'ſ', '"') OR key IS NOT NULL THEN place END AS "position" FROM tk6)"""


def _tokens(spark, d, once=()):
    return Wd.tokens(V.words(spark, d), ["word"], "word", once)


@query(
    "st01_word_shaping",
    V.with_views(V.WORDS, SHAPE, body="SELECT word, string_agg(coalesce(key, '?'), ' ' ORDER BY i) AS keys FROM tok GROUP BY 1"),
)
def _(spark, d):
    t = _tokens(spark, d)
    g = t.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("key", F.lit("?")).alias("key")))).alias("k"))
    return g.select("word", F.array_join(F.transform("k", lambda s: s["key"]), " ").alias("keys"))


@query(
    "st02_positions",
    V.with_views(V.WORDS, SHAPE, body='SELECT key, "position", count(*) AS n, count(DISTINCT word) AS n_words FROM tok GROUP BY 1, 2'),
)
def _(spark, d):
    kinds = _tokens(spark, d, ["key", "position"])
    return kinds.groupBy("key", "position").agg(F.sum("n").alias("n"), F.count("word").alias("n_words"))


CHUNKS = r"""
word AS (SELECT DISTINCT unnest(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS word FROM documents)"""


@query(
    "st03_context_forms",
    V.with_views(
        CHUNKS, SHAPE, body="SELECT text, key, \"position\", joins, count(*) AS n FROM tok WHERE text IN ('s', 'ſ') OR NOT joins GROUP BY 1, 2, 3, 4"
    ),
)
def _(spark, d):
    """Context-dependent and detached tokens over whitespace-separated chunks, with their punctuation."""
    docs = V.table(spark, d, "documents").select(F.explode_outer(F.split(X.squeeze(F.col("text")), " ")).alias("word")).distinct()
    t = Wd.tokens(docs, ["word"], "word").where(F.col("text").isin("s", "ſ") | ~F.col("joins"))
    return t.groupBy("text", "key", "position", "joins").agg(F.count(F.lit(1)).alias("n"))


@query(
    "st04_cluster_fallback",
    V.with_views(
        V.WORDS,
        SHAPE,
        """sp AS (SELECT *, ligature AND "position" IS NOT NULL AND length(text) >= 2 AND key NOT IN ('ch', 'qu') AS split FROM tok),
un AS (SELECT key AS k0, "position" AS p0, split, text, unnest(CASE WHEN split THEN range(1, length(text) + 1) ELSE [1] END) AS part FROM sp),
pl AS (SELECT *, CASE WHEN NOT split THEN p0 WHEN part = 1 AND p0 = 'initial' THEN 'initial' WHEN part = length(text) AND p0 = 'final' THEN 'final' ELSE 'medial' END AS place FROM un)""",
        body="""SELECT CASE WHEN NOT split THEN k0 WHEN text[part] IN ('s', 'ſ') THEN CASE WHEN place = 'final' THEN 's' ELSE 'longs' END ELSE text[part] END AS key, place AS "position", count(*) AS n FROM pl GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    inv = X.registry(spark).where("key IN ('ch', 'qu')").select("key")
    parts = Wd.without_missing_clusters(_tokens(spark, d), inv, ["word"])
    return parts.groupBy("key", "position").agg(F.count(F.lit(1)).alias("n"))


@query(
    "st05_display_forms",
    r"""SELECT page_id, replace(url, '|', '') AS shown, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')) AS squeezed FROM pages""",
)
def _(spark, d):
    u = F.col("url")
    return V.table(spark, d, "pages").select(
        "page_id", X.strip_marker(u).alias("shown"), X.squeeze(F.regexp_replace(F.lower(u), "[^a-z0-9]+", " ")).alias("squeezed")
    )


@query(
    "st07_capitals",
    V.with_views(
        V.WORDS,
        body="SELECT upper(word[1]) = word[1] AND lower(word[1]) <> word[1] AS capital, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n FROM word GROUP BY 1",
    ),
)
def _(spark, d):
    return V.words(spark, d).groupBy(X.is_capitalised(F.col("word")).alias("capital")).agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n"))


@query(
    "st08_expected_marks",
    V.with_views(V.WORDS, SHAPE, body="SELECT word, CAST(count(*) FILTER (key IN (" + _list(X.MARKS_PER_KEY) + ")) AS INTEGER) AS marks FROM tok WHERE key IS NOT NULL GROUP BY 1"),
)
def _(spark, d):
    return Wd.word_keys(_tokens(spark, d).where("key IS NOT NULL"), ["word"]).select("word", X.expected_marks(F.col("slots")).alias("marks"))


@query(
    "so05_distinct_keys",
    V.with_views(
        V.WORDS, SHAPE, body="SELECT word, string_agg(key, ' ' ORDER BY i) AS keys FROM (SELECT word, key, min(i) AS i FROM tok WHERE key IS NOT NULL GROUP BY 1, 2) GROUP BY 1"
    ),
)
def _(spark, d):
    keys = Wd.word_keys(_tokens(spark, d).where("key IS NOT NULL"), ["word"])
    return keys.select("word", F.array_join(F.array_distinct("slots"), " ").alias("keys"))


@query(
    "wn17_quote_parity",
    """SELECT doc_id, n - n // 2 AS low, n // 2 AS high FROM (SELECT doc_id, length(text) - length(replace(text, '''', '')) AS n FROM documents) WHERE n > 0""",
)
def _(spark, d):
    """Apostrophes stand in for straight quotes, which the texts do not hold."""
    docs = V.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("w", "word"))
    marks = docs.where(F.contains("word", F.lit("'"))).select("doc_id", "w", F.posexplode(F.regexp_extract_all("word", F.lit("(')"), 1)).alias("i", "m"))
    t = marks.select("doc_id", "w", "i", F.lit(True).alias("quote"), F.lit(None).cast("string").alias("key"))
    p = Wd.quote_parity(t, ["doc_id"], ["w", "i"])
    return p.groupBy("doc_id").agg(F.count_if(F.col("key") == "quote-low").alias("low"), F.count_if(F.col("key") == "quote-high").alias("high"))


READY = "'e', 'n', 'r', 't', 'a', 'i', 'o', 'd', 'h', 'l', 'longs', 's'"


@query(
    "jn16_inventory_coverage",
    V.with_views(
        V.WORDS,
        SHAPE,
        body=f"""SELECT word, bool_and(key IN ({READY})) AS qualifies, count(DISTINCT key) FILTER (key NOT IN ({READY})) AS missing FROM tok WHERE key IS NOT NULL GROUP BY 1""",
    ),
)
def _(spark, d):
    inv = X.registry(spark).where("joins").select("key").unionByName(spark.createDataFrame([("longs",), ("s",)], "key STRING")).distinct()
    inv = inv.withColumn("ready", F.expr(f"key IN ({READY})"))
    return Wd.coverage(_tokens(spark, d, ["key"]), inv, ["word"], once=True)


def _answers(spark, d):
    b = V.table(spark, d, "benchmark")
    return b.select(F.explode_outer(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("word")).where("word IS NOT NULL").distinct()


LOOK = r"""
answer AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM benchmark),
fa AS (SELECT word AS answer, upper(word[1]) = word[1] AND lower(word[1]) <> word[1] AS cap, length(word) AS len, lower(word[1]) AS f, lower(word[-1]) AS l FROM answer),
fb AS (SELECT word AS candidate, upper(word[1]) = word[1] AND lower(word[1]) <> word[1] AS cap, length(word) AS len, lower(word[1]) AS f, lower(word[-1]) AS l FROM word),
pr AS (SELECT answer, candidate, a.len = b.len AS same, 2 * (a.f = b.f)::INTEGER + 2 * (a.l = b.l)::INTEGER AS ends FROM fa a JOIN fb b ON a.cap = b.cap AND b.len BETWEEN a.len - 1 AND a.len + 1
  AND (a.f = b.f OR a.l = b.l) AND answer <> candidate),
sc AS (SELECT answer, candidate, same, CASE WHEN NOT same THEN ends - 1 ELSE ends + CAST(list_sum(list_transform(range(1, length(answer) + 1), lambda i: CASE WHEN lower(answer[i]) = lower(candidate[i]) THEN 0
  WHEN list_contains([""" + _list(x + y for p in X.CONFUSABLE for x, y in (p, p[::-1])) + r"""], lower(answer[i]) || lower(candidate[i])) THEN 1 ELSE -2 END)) AS INTEGER) END AS score FROM pr),
ok AS (SELECT * FROM sc WHERE score > 0)"""


@query(
    "tk01_best_lookalikes",
    V.with_views(
        V.WORDS,
        LOOK,
        body="SELECT answer, candidate, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY answer ORDER BY score DESC, candidate) AS INTEGER) AS place FROM ok) WHERE place <= 4",
    ),
)
def _(spark, d):
    return Wd.best_lookalikes(_answers(spark, d), V.words(spark, d).select("word"), 4)


@query(
    "jn15_plausible_counts",
    V.with_views(
        V.WORDS,
        LOOK,
        body="SELECT a.answer, count(*) FILTER (NOT same) AS other_length, count(*) FILTER (same) AS same_length, count(same) AS plausible FROM fa a LEFT JOIN ok USING (answer) GROUP BY 1",
    ),
)
def _(spark, d):
    return Wd.plausible_counts(_answers(spark, d), V.words(spark, d).select("word"))


@query(
    "st06_equal_length_scores",
    V.with_views(V.WORDS, LOOK, body="SELECT score, count(*) AS pairs, count(DISTINCT answer) AS answers FROM ok WHERE same GROUP BY 1"),
)
def _(spark, d):
    p = Wd.equal_length_pairs(_answers(spark, d), V.words(spark, d).select("word"))
    return p.groupBy("score").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("answer").alias("answers"))


@query(
    "tk04_weighted_sample",
    """WITH w AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 8.0 ELSE 1.0 END::DOUBLE AS wt, ((o_orderkey * 2654435761) % 4294967296 + 0.5::DOUBLE) / 4294967296 AS u FROM orders)
SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY -ln(u) / wt, o_orderkey) AS INTEGER) AS place FROM w) WHERE place <= 3""",
)
def _(spark, d):
    o = V.table(spark, d, "orders")
    u = ((F.col("o_orderkey") * 2654435761) % 4294967296 + 0.5) / 4294967296
    weight = F.when(F.col("o_orderpriority") == "1-URGENT", 8.0).otherwise(1.0)
    return Wd.weighted_sample(o, ["o_custkey"], 3, weight, u, "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query(
    "tk04_pinned_sample",
    """WITH w AS (SELECT o_custkey, o_orderkey, o_orderpriority = '1-URGENT' AS pin, o_orderkey % 4 - 1 AS score, ((o_orderkey * 2654435761) % 4294967296 + 0.5::DOUBLE) / 4294967296 AS u FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, pin ORDER BY u, o_orderkey) = 1 AND pin AS anchor FROM w)
SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN anchor THEN 0 WHEN pin OR score > 0 THEN 1 ELSE 2 END,
  CASE WHEN pin THEN -ln(u) / 8 WHEN score > 0 THEN -ln(u) / score ELSE u END, o_orderkey) AS INTEGER) AS place FROM a) WHERE place <= 4""",
)
def _(spark, d):
    o = V.table(spark, d, "orders")
    u = ((F.col("o_orderkey") * 2654435761) % 4294967296 + 0.5) / 4294967296
    c = Wd.pinned_sample(o, ["o_custkey"], 4, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 4 - 1, u, "o_orderkey")
    return c.select("o_custkey", "o_orderkey", "place")


def _sessions(spark, d):
    e = V.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    e = dense_position(e, ["user_id"], ["ts", "event_id"], V.hour_bucket("ts"))
    return e.withColumn("ok", F.col("event_type") != "error")


STREAKS = """
s0 AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
s1 AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS bad FROM s0),
s2 AS (SELECT user_id, bad, count(*) AS len, max(pos) AS e FROM s1 WHERE ok GROUP BY 1, 2),
s3 AS (SELECT user_id, count(*) AS seen, count(*) FILTER (ok) AS correct, max(pos) AS m FROM s0 GROUP BY 1)"""
STREAK_BODY = """SELECT user_id, seen, correct, coalesce((SELECT len FROM s2 WHERE s2.user_id = s3.user_id AND e = m), 0) AS streak, coalesce((SELECT max(len) FROM s2 WHERE s2.user_id = s3.user_id), 0) AS best_streak FROM s3"""


@query("ag43_session_tallies", V.with_views(STREAKS, body=STREAK_BODY))
def _(spark, d):
    return Wd.session_tallies(_sessions(spark, d), ["user_id"], "pos", "ok")


@query(
    "wn12_streaks",
    V.with_views(STREAKS, body="SELECT user_id, len, count(*) AS n FROM s2 GROUP BY 1, 2"),
)
def _(spark, d):
    from traceframe.functions.ordered import running_total

    t = running_total(_sessions(spark, d), ["user_id"], "pos", {"bad": (~F.col("ok")).cast("int")})
    runs = t.where("ok").groupBy("user_id", "bad").agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy("user_id", "len").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ag43_confusions",
    V.with_views(V.PAIRS, body="SELECT left_key AS correct, right_key AS guessed, count(*) AS n FROM tr WHERE left_key <> right_key GROUP BY 1, 2"),
)
def _(spark, d):
    return Wd.confusions(V.transitions(spark, d).select(F.col("left_key").alias("correct"), F.col("right_key").alias("guessed")), [], "correct", "guessed")


@query(
    "ag44_bank_checks",
    """WITH b AS (SELECT p_name AS word, CASE WHEN p_size % 9 = 0 THEN [] WHEN p_size % 5 = 0 THEN [p_type, p_name] WHEN p_size % 4 = 0 THEN [p_type, p_type] ELSE [p_type] END AS d,
  CASE WHEN p_size < 20 THEN 'modern' WHEN p_size < 45 THEN 'historic' ELSE 'odd' END AS era, CASE WHEN p_size % 2 = 0 THEN p_brand END AS note, CASE WHEN p_size % 6 = 0 THEN p_type ELSE p_name END AS marked FROM part)
SELECT word, problem, count(*) AS n FROM (SELECT word, 'duplicate_word' AS problem FROM b GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT word, 'era' FROM b WHERE era = 'odd' UNION ALL SELECT word, 'no_distractor' FROM b WHERE len(d) = 0
UNION ALL SELECT word, 'answer_in_list' FROM b WHERE list_contains(d, word) UNION ALL SELECT word, 'duplicate_in_list' FROM b WHERE len(list_distinct(d)) < len(d)
UNION ALL SELECT word, 'historic_without_note' FROM b WHERE era = 'historic' AND note IS NULL UNION ALL SELECT word, 'marked_form' FROM b WHERE replace(marked, '|', '') <> word) GROUP BY 1, 2""",
)
def _(spark, d):
    s = F.col("p_size")
    empty = F.array().cast("array<string>")
    bank = V.table(spark, d, "part").select(
        F.col("p_name").alias("word"),
        F.when(s % 9 == 0, empty).when(s % 5 == 0, F.array("p_type", "p_name")).when(s % 4 == 0, F.array("p_type", "p_type")).otherwise(F.array("p_type")).alias("distractors"),
        F.when(s < 20, "modern").when(s < 45, "historic").otherwise("odd").alias("era"),
        F.when(s % 2 == 0, F.col("p_brand")).alias("note"),
        F.when(s % 6 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("marked"),
    )
    return Wd.bank_problems(bank, ["modern", "historic"]).groupBy("word", "problem").agg(F.count(F.lit(1)).alias("n"))
