"""Queries over labelled rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions.ordered import dense_rank_of
from traceframe.functions.stats import r
from traceframe.operators import labels as L
from traceframe.plans import views as V
from traceframe.plans.registry import query

CODES, FINDINGS = L.CODES, L.FINDINGS


def _shown(spark, d):
    return L.shown(V.verdicts(spark, d), V.label_key(spark, d))


def _pool(spark, d):
    return L.evaluated(_shown(spark, d), V.label_metrics(spark, d))


PAIRS = V.LABELS + """,
rp AS (SELECT k.uid, a.codes AS a, b.codes AS b, a.codes IS NULL OR b.codes IS NULL AS missing FROM lkey k LEFT JOIN verdict a ON a.uid = k.repeat_of
  LEFT JOIN verdict b ON b.uid = k.uid WHERE k.repeat_of IS NOT NULL),
codes AS (SELECT unnest(['G', 'A', 'W', 'B', 'E', 'K', 'U']) AS code)"""


@query(
    "ag32_reliability",
    V.with_views(
        PAIRS,
        """g AS (SELECT code, count(*) AS pairs, count(*) FILTER (list_contains(a, code) AND list_contains(b, code)) AS yes, count(*) FILTER (NOT list_contains(a, code) AND NOT list_contains(b, code)) AS no
  FROM rp, codes WHERE NOT missing GROUP BY 1)""",
        body="""SELECT code, pairs, yes, no, pairs - yes - no AS disagree, pairs - no AS carried, round((yes + no) / pairs, 6) AS rate,
  CASE WHEN (yes + no) / pairs >= 10 / 12 THEN 'reliable' WHEN (yes + no) / pairs <= 7 / 12 THEN 'coin flip' ELSE 'middling' END AS band, pairs - no < 3 AS too_few FROM g""",
    ),
)
def _(spark, d):
    rel = L.reliability(L.repeat_pairs(V.verdicts(spark, d), V.label_key(spark, d)))
    return rel.withColumn("rate", r("rate"))


@query(
    "ag32_exact_agreement",
    V.with_views(
        PAIRS,
        body="SELECT count(*) FILTER (NOT missing) AS pairs, count(*) FILTER (missing) AS missing, count(*) FILTER (NOT missing AND list_sort(a) = list_sort(b)) AS exact FROM rp",
    ),
)
def _(spark, d):
    return L.exact_agreement(L.repeat_pairs(V.verdicts(spark, d), V.label_key(spark, d)))


@query(
    "ag33_occupancy",
    V.with_views(
        PAIRS,
        body="SELECT code, count(*) FILTER (list_contains(s.codes, code)) AS n, round(count(*) FILTER (list_contains(s.codes, code)) / count(*), 6) AS share, count(*) FILTER (list_contains(s.codes, code)) < 8 AS too_few FROM shown s, codes GROUP BY 1",
    ),
)
def _(spark, d):
    return L.occupancy(_shown(spark, d)).withColumn("share", r("share"))


@query(
    "ag33_totals",
    V.with_views(
        V.LABELS,
        """s AS (SELECT *, len(findings) > 0 OR unratable AS flagged FROM shown)""",
        body="""SELECT count(*) AS total, count(*) FILTER (flagged) AS flagged, count(*) FILTER (list_contains(codes, 'G') AND len(findings) > 0) AS good_with_finding,
  count(*) FILTER (list_contains(codes, 'U')) AS unsure, count(*) FILTER (flagged AND sx IS NOT NULL) AS marker_on_flagged, round(count(*) FILTER (flagged AND sx IS NOT NULL) / count(*) FILTER (flagged), 6) AS marker_rate FROM s""",
    ),
)
def _(spark, d):
    return L.occupancy_totals(_shown(spark, d)).withColumn("marker_rate", r("marker_rate"))


@query(
    "ag33_verdict_sizes",
    V.with_views(V.LABELS, body="SELECT CAST(len(list_filter(codes, lambda c: c <> 'U')) AS INTEGER) AS size, count(*) AS n FROM shown GROUP BY 1"),
)
def _(spark, d):
    return L.verdict_sizes(_shown(spark, d))


@query(
    "ag33_overlap",
    V.with_views(
        PAIRS,
        """f AS (SELECT code, row_number() OVER () AS o FROM (SELECT unnest(['A', 'W', 'B', 'E']) AS code))""",
        body="""SELECT a.code AS "left", b.code AS "right", count(*) FILTER (list_contains(s.codes, a.code) AND list_contains(s.codes, b.code)) AS both,
  count(*) FILTER (list_contains(s.codes, a.code) OR list_contains(s.codes, b.code)) AS "union",
  round(count(*) FILTER (list_contains(s.codes, a.code) AND list_contains(s.codes, b.code)) / count(*) FILTER (list_contains(s.codes, a.code) OR list_contains(s.codes, b.code)), 6) AS share
FROM shown s, f a JOIN f b ON a.o < b.o GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    return L.finding_overlap(_shown(spark, d)).withColumn("share", r("share"))


POOL = V.LABELS + """,
pool AS (SELECT s.*, m.* EXCLUDE (uid) FROM (SELECT * FROM shown WHERE NOT unratable) s LEFT JOIN metric m USING (uid))"""


@query(
    "ag34_gate_validation",
    V.with_views(
        POOL,
        """t AS (SELECT 'A' AS target, list_contains(codes, 'A') AS hit, spike >= 8.0 AS rej FROM pool WHERE spike IS NOT NULL UNION ALL SELECT 'any finding', len(findings) > 0, spike >= 8.0 FROM pool WHERE spike IS NOT NULL)""",
        body="""SELECT target, count(*) FILTER (hit) AS positives, count(*) FILTER (hit AND rej) AS caught, count(*) FILTER (rej) AS rejected, count(*) AS evaluated,
  round(count(*) FILTER (hit AND rej) / count(*) FILTER (rej), 6) AS precision, round(count(*) FILTER (hit AND rej) / count(*) FILTER (hit), 6) AS recall FROM t GROUP BY 1""",
    ),
)
def _(spark, d):
    g = L.gate_validation(_pool(spark, d), "spike", ">=", 8.0, "A")
    return g.withColumn("precision", r("precision")).withColumn("recall", r("recall"))


@query(
    "ag34_missed_values",
    V.with_views(POOL, body="SELECT spike AS value, count(*) AS n FROM pool WHERE spike < 8.0 AND list_contains(codes, 'A') GROUP BY 1"),
)
def _(spark, d):
    return L.missed_values(_pool(spark, d), "spike", ">=", 8.0, "A")


@query(
    "ag34_rejected_verdicts",
    V.with_views(POOL, body="SELECT CASE WHEN len(findings) = 0 THEN '-' ELSE array_to_string(findings, '') END AS verdict, count(*) AS n FROM pool WHERE spike >= 8.0 GROUP BY 1"),
)
def _(spark, d):
    return L.rejected_verdicts(_pool(spark, d), "spike", ">=", 8.0)


@query(
    "ag35_roc_auc",
    """WITH v AS (SELECT lang, CAST(n_chars AS DOUBLE) AS v, quality = 1 AS hit FROM documents JOIN labels USING (doc_id))
SELECT p.lang, round(avg(CASE WHEN p.v > n.v THEN 1.0 WHEN p.v = n.v THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS auc, count(DISTINCT p.k) AS n_pos, count(DISTINCT n.k) AS n_neg
FROM (SELECT *, row_number() OVER () AS k FROM v WHERE hit) p JOIN (SELECT *, row_number() OVER () AS k FROM v WHERE NOT hit) n USING (lang) GROUP BY 1""",
)
def _(spark, d):
    docs = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id")
    a = L.roc_auc(docs.select("lang", "n_chars", (F.col("quality") == 1).alias("hit")), ["lang"], "n_chars", "hit")
    return a.select("lang", r("auc").alias("auc"), "n_pos", "n_neg").where("auc IS NOT NULL")


@query(
    "ag36_auc_error",
    """WITH v AS (SELECT CAST(n_chars AS DOUBLE) AS v, toxic = 1 AS hit FROM documents JOIN labels USING (doc_id)),
a AS (SELECT avg(CASE WHEN p.v > n.v THEN 1.0 WHEN p.v = n.v THEN 0.5 ELSE 0.0 END::DOUBLE) AS auc, (SELECT count(*) FROM v WHERE hit) AS np, (SELECT count(*) FROM v WHERE NOT hit) AS nn FROM (SELECT v FROM v WHERE hit) p, (SELECT v FROM v WHERE NOT hit) n)
SELECT round(auc, 6) AS auc, round(sqrt(greatest(0, (auc * (1 - auc) + (np - 1) * (auc / (2 - auc) - auc * auc) + (nn - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (np * nn))), 6) AS se FROM a""",
)
def _(spark, d):
    docs = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id")
    a = L.roc_auc(docs.select("n_chars", (F.col("toxic") == 1).alias("hit")), [], "n_chars", "hit")
    return a.select(r("auc").alias("auc"), r("se").alias("se"))


MATRIX = POOL + """,
tg AS (SELECT uid, unnest(['A', 'W', 'B', 'E', 'W∪B', 'any']) AS target, unnest([list_contains(codes, 'A'), list_contains(codes, 'W'), list_contains(codes, 'B'), list_contains(codes, 'E'),
  list_contains(codes, 'W') OR list_contains(codes, 'B'), len(findings) > 0]) AS hit FROM pool),
mt AS (""" + " UNION ALL ".join(f"SELECT uid, '{m}' AS metric, {m} AS v FROM pool" for m in V.METRICS) + """),
cell AS (SELECT metric, target, hit, v, rank() OVER (PARTITION BY metric, target ORDER BY v) + (count(*) OVER (PARTITION BY metric, target, v) - 1) / 2 AS rk FROM mt JOIN tg USING (uid) WHERE v IS NOT NULL),
ca AS (SELECT metric, target, count(*) FILTER (hit) AS n_pos, count(*) FILTER (NOT hit) AS n_neg, sum(rk) FILTER (hit) AS rs FROM cell GROUP BY 1, 2),
pos AS (SELECT target, count(*) FILTER (hit) < 8 AND target <> 'any' AS too_few FROM tg GROUP BY 1),
cb AS (SELECT *, CASE WHEN n_pos > 0 AND n_neg > 0 AND NOT too_few THEN (rs - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) END AS auc FROM ca JOIN pos USING (target))"""


@query(
    "ag37_coverage_matrix",
    V.with_views(
        MATRIX,
        body="""SELECT metric, target, round(auc, 6) AS auc, round(sqrt(greatest(0, (auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n_pos * n_neg))), 6) AS se,
  n_pos, n_neg, too_few FROM cb""",
    ),
)
def _(spark, d):
    m = L.coverage_matrix(_pool(spark, d), V.METRICS, [("W", "B")])
    return m.withColumn("auc", r("auc")).withColumn("se", r("se"))


@query(
    "ag37_flag_rates",
    V.with_views(
        MATRIX,
        body="""SELECT target, count(*) FILTER (hit AND at_edge) AS "set", count(*) FILTER (hit) AS n_pos, count(*) FILTER (NOT hit AND at_edge) AS set_elsewhere, count(*) FILTER (NOT hit) AS n_neg
FROM tg JOIN pool USING (uid) WHERE at_edge IS NOT NULL GROUP BY 1""",
    ),
)
def _(spark, d):
    return L.flag_rates(_pool(spark, d), "at_edge", [("W", "B")])


PLACE = V.LABELS + """,
pl AS (SELECT s.*, m.* EXCLUDE (uid), sx IS NOT NULL AS marked, sx IS NOT NULL AND coalesce(has_place, false) AS usable FROM shown s LEFT JOIN metric m USING (uid))"""


@query(
    "ag38_place_totals",
    V.with_views(
        PLACE,
        body="""SELECT count(*) AS shown, count(*) FILTER (marked) AS marked, count(*) FILTER (usable) AS usable, count(*) FILTER (marked AND NOT usable) AS without_geometry,
  count(*) FILTER (usable AND abs(idx - argmax_idx) <= 4) AS argmax_hits, count(*) FILTER (usable AND edge_dist <= 3) AS at_boundary, count(*) FILTER (usable AND len(findings) = 1 AND NOT unratable) AS single_finding FROM pl""",
    ),
)
def _(spark, d):
    return L.place_check(_shown(spark, d), V.label_metrics(spark, d))


@query(
    "ag38_place_per_category",
    V.with_views(
        PLACE,
        """f AS (SELECT unnest(['A', 'W', 'B', 'E']) AS code), sg AS (SELECT * FROM pl WHERE usable AND len(findings) = 1 AND NOT unratable)""",
        body="""SELECT code, count(*) FILTER (h) AS n, count(*) FILTER (h AND rel < 0.1::DOUBLE) AS head, count(*) FILTER (h AND rel > 0.9::DOUBLE) AS tail, count(*) FILTER (h AND edge_dist <= 3) AS at_boundary,
  count(*) FILTER (h) - count(*) FILTER (h AND rel < 0.1::DOUBLE) - count(*) FILTER (h AND rel > 0.9::DOUBLE) AS middle, count(*) FILTER (h) < 8 AS too_few FROM (SELECT code, list_contains(codes, code) AS h, rel, edge_dist FROM sg, f) GROUP BY 1""",
    ),
)
def _(spark, d):
    return L.place_per_category(_shown(spark, d), V.label_metrics(spark, d))


@query(
    "ag39_drift",
    V.with_views(
        V.LABELS,
        """o AS (SELECT *, row_number() OVER (ORDER BY "position") - 1 AS k, count(*) OVER () AS n FROM shown),
b AS (SELECT *, CASE WHEN k >= round_even(2.0::DOUBLE * n / 3, 0) THEN 2 WHEN k >= round_even(1.0::DOUBLE * n / 3, 0) THEN 1 ELSE 0 END AS block FROM o)""",
        body="SELECT block, count(*) AS n, " + ", ".join(f"count(*) FILTER (list_contains(codes, '{c}')) AS \"n_{c}\"" for c in CODES)
        + ", count(sx) AS marked, count(seconds) AS timed, median(seconds) AS seconds_median FROM b GROUP BY 1",
    ),
)
def _(spark, d):
    return L.drift(_shown(spark, d))


@query(
    "ag40_label_report",
    V.with_views(
        PAIRS,
        body="""SELECT 1 AS step, 'pairs' AS item, CAST(count(*) FILTER (NOT missing) AS DOUBLE) AS value FROM rp UNION ALL SELECT 1, 'exact', count(*) FILTER (NOT missing AND list_sort(a) = list_sort(b)) FROM rp
UNION ALL SELECT 2, 'total', count(*) FROM shown UNION ALL SELECT 2, 'flagged', count(*) FILTER (len(findings) > 0 OR unratable) FROM shown
UNION ALL SELECT 3, 'rejected', count(*) FILTER (NOT unratable AND spike >= 8.0) FROM shown JOIN metric USING (uid) UNION ALL SELECT 5, 'marked', count(sx) FROM shown
UNION ALL SELECT 6, 'notes', count(note) FROM shown UNION ALL SELECT 6, 'dropped_unsure', count(*) FILTER (list_contains(codes, 'U')) FROM shown""",
    ),
)
def _(spark, d):
    """Headline numbers of the full report, one row per step and item."""
    v, k, m = V.verdicts(spark, d), V.label_key(spark, d), V.label_metrics(spark, d)
    s = L.shown(v, k)

    def rows(df, step, *items):
        cols = F.array(*[F.struct(F.lit(step).alias("step"), F.lit(i).alias("item"), F.col(i).cast("double").alias("value")) for i in items])
        return df.select(F.explode(cols).alias("r")).select("r.*")

    gate = L.gate_validation(L.evaluated(s, m), "spike", ">=", 8.0, "A").where("target = 'A'")
    notes = s.agg(F.count("note").alias("notes"), F.count_if(L.has("U")).alias("dropped_unsure"))
    return (
        rows(L.exact_agreement(L.repeat_pairs(v, k)), 1, "pairs", "exact")
        .unionByName(rows(L.occupancy_totals(s), 2, "total", "flagged"))
        .unionByName(rows(gate, 3, "rejected"))
        .unionByName(rows(L.place_check(s, m), 5, "marked"))
        .unionByName(rows(notes, 6, "notes", "dropped_unsure"))
    )


@query(
    "ag41_select_identities",
    V.with_views(
        V.LABELS,
        body="""SELECT glyph, "position", uid, n FROM (SELECT k.glyph, v."position", v.uid, count(*) OVER (PARTITION BY k.glyph) AS n, row_number() OVER (PARTITION BY k.glyph ORDER BY v."position") AS rn,
  bool_or(list_contains(codes, 'A') AND list_contains(codes, 'B')) OVER (PARTITION BY k.glyph) AS hit FROM verdict v JOIN lkey k USING (uid)) WHERE hit AND rn = 1""",
    ),
)
def _(spark, d):
    j = V.verdicts(spark, d).join(V.label_key(spark, d), "uid")
    return L.select_identities(j, "glyph", ["A", "B"], ["position", "uid"])


@query(
    "wn01_global_rank",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders",
)
def _(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return dense_rank_of(o, [], "o_totalprice", "o_orderkey", "rank", descending=True).select("o_orderkey", "rank")


def _hash(col: str):
    """A shuffle key both engines can compute: a multiplicative hash."""
    return (F.col(col) * 2654435761) % 4294967296


DEAL = """
rk AS (SELECT doc_id, 'g' || (doc_id % 12) AS glyph, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents),
bd AS (SELECT *, CAST(floor(rank / ceil(n / 6)) AS INTEGER) AS band FROM rk),
sh AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) - 1 AS rr FROM bd),
deal AS (SELECT *, row_number() OVER (ORDER BY rr, band) - 1 AS place FROM sh)"""


def _deal(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.concat(F.lit("g"), (F.col("doc_id") % 12).cast("string")).alias("glyph"), "n_chars")
    return L.stratified(docs, "n_chars", "doc_id", 6, 600, _hash("doc_id"))


@query(
    "wn02_stratified_deal",
    V.with_views(DEAL, body="SELECT doc_id, rank, band, place, CASE WHEN place < 600 THEN 'label' ELSE 'reserve' END AS \"set\" FROM deal"),
)
def _(spark, d):
    return _deal(spark, d).select("doc_id", "rank", "band", "place", "set")


REPEATS = DEAL + """,
lb AS (SELECT * FROM deal WHERE place < 600),
cm AS (SELECT glyph FROM lb GROUP BY 1 HAVING count(*) >= 6),
pk AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS pr FROM lb WHERE glyph IN (SELECT glyph FROM cm) AND glyph <> 'g3' AND place < (SELECT count(*) FROM lb) - 40 - 25),
ps AS (SELECT * FROM pk ORDER BY pr, band LIMIT 24),
sq AS (SELECT doc_id, CAST(place AS DOUBLE) AS at_, NULL AS first_place FROM lb UNION ALL SELECT doc_id, place + 40 + (doc_id * 2654435761) % 26 - 0.5::DOUBLE, place FROM ps)"""


def _picks(spark, d):
    label = _deal(spark, d).where(F.col("set") == "label")
    return label, L.picked_repeats(label, "glyph", "doc_id", 24, 40, ["g3"], _hash("doc_id"))


@query("wn03_picked_repeats", V.with_views(REPEATS, body="SELECT doc_id, glyph, band, place FROM ps"))
def _(spark, d):
    return _picks(spark, d)[1].select("doc_id", "glyph", "band", "place")


@query(
    "wn03_sequence_gaps",
    V.with_views(
        REPEATS,
        """fin AS (SELECT doc_id, first_place, row_number() OVER (ORDER BY at_, doc_id) - 1 AS s FROM sq)""",
        body="SELECT b.doc_id, b.s AS sequence, b.s - a.s AS gap FROM fin b JOIN fin a ON a.doc_id = b.doc_id AND a.first_place IS NULL WHERE b.first_place IS NOT NULL",
    ),
)
def _(spark, d):
    label, picks = _picks(spark, d)
    seq = L.with_repeats(label, picks, "doc_id", 40, (F.col("doc_id") * 2654435761) % 26)
    first = seq.where("first_place IS NULL").select("doc_id", F.col("sequence").alias("s0"))
    again = seq.where("first_place IS NOT NULL").select("doc_id", "sequence")
    return again.join(first, "doc_id").select("doc_id", "sequence", (F.col("sequence") - F.col("s0")).alias("gap"))
