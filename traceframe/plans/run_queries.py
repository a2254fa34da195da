"""Queries over bench runs, arms and two-sided rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions.stats import r, safe_round
from traceframe.operators import runs as R
from traceframe.plans import views as V
from traceframe.plans.registry import query

MEDIANS = ["dtw_xh", "aiou", "chamfer_cand_ref_xh", "chamfer_ref_cand_xh", "retrace_arc_ratio"]


def _ab(spark, d):
    return V.run_rows(spark, d, "A"), V.run_rows(spark, d, "R")


AB = V.RUNS + """,
ra AS (SELECT * FROM runs WHERE side = 'A'), rb AS (SELECT * FROM runs WHERE side = 'R')"""


@query(
    "jn01_paired_runs",
    V.with_views(
        AB,
        body="""SELECT id, round(a.dtw_xh, 9) AS a_dtw_xh, round(b.dtw_xh, 9) AS b_dtw_xh FROM ra a JOIN rb b USING (id)
WHERE a.status = 'ok' AND b.status = 'ok'""",
    ),
)
def _(spark, d):
    a, b = (x.where("status = 'ok'") for x in _ab(spark, d))
    j = R.paired(a, b, ["id"], ["dtw_xh"])
    return j.select("id", r("a_dtw_xh", 9).alias("a_dtw_xh"), r("b_dtw_xh", 9).alias("b_dtw_xh"))


@query(
    "jn02_full_outer_sides",
    V.with_views(
        AB,
        body="""SELECT id, CASE WHEN a.id IS NULL THEN 'only_b' WHEN b.id IS NULL THEN 'only_a' ELSE 'both' END AS side,
  coalesce(a.status <> b.status, true) AS differs FROM ra a FULL OUTER JOIN rb b USING (id)""",
    ),
)
def _(spark, d):
    j = R.paired(*_ab(spark, d), ["id"], ["status"], "full_outer")
    return j.select("id", "side", F.coalesce(F.col("a_status") != F.col("b_status"), F.lit(True)).alias("differs"))


@query(
    "jn03_left_enrichment",
    """SELECT l.doc_id, d.source, d.n_chars, d.doc_id IS NULL AS missing FROM labels l LEFT JOIN documents d USING (doc_id)""",
)
def _(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "source", "n_chars", F.lit(True).alias("_hit"))
    j = V.table(spark, d, "labels").select("doc_id").join(docs, "doc_id", "left")
    return j.select("doc_id", "source", "n_chars", F.col("_hit").isNull().alias("missing"))


@query(
    "jn04_absent_as_skipped",
    V.with_views(
        AB,
        body="""SELECT id, coalesce(b.status, 'skipped') AS status FROM ra a LEFT JOIN rb b USING (id)""",
    ),
)
def _(spark, d):
    a, b = _ab(spark, d)
    j = a.select("id").join(b.select("id", "status"), "id", "left")
    return j.select("id", F.coalesce("status", F.lit("skipped")).alias("status"))


@query(
    "jn04_semi_anti",
    """SELECT n_name, exists(SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS has_rich,
  NOT exists(SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900) AS no_debtor FROM nation""",
)
def _(spark, d):
    n = V.table(spark, d, "nation")
    rich = V.table(spark, d, "supplier").where("s_acctbal > 5000")
    debt = V.table(spark, d, "customer").where("c_acctbal < -900")
    semi = n.join(rich, n.n_nationkey == rich.s_nationkey, "left_semi").select("n_nationkey", F.lit(True).alias("hr"))
    anti = n.join(debt, n.n_nationkey == debt.c_nationkey, "left_anti").select("n_nationkey", F.lit(True).alias("nd"))
    j = n.join(semi, "n_nationkey", "left").join(anti, "n_nationkey", "left")
    return j.select(
        "n_name", F.coalesce("hr", F.lit(False)).alias("has_rich"), F.coalesce("nd", F.lit(False)).alias("no_debtor")
    )


SUMMARY = """, """.join(f"median({c}) FILTER (status = 'ok') AS {c}_median" for c in MEDIANS)


@query(
    "ag13_run_summary",
    V.with_views(
        V.RUNS,
        """
worst AS (SELECT side, dtw_xh AS dtw_xh_worst, id AS worst_id FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY dtw_xh DESC, id DESC) AS rn
  FROM runs WHERE status = 'ok' AND dtw_xh IS NOT NULL) WHERE rn = 1)""",
        body="SELECT side, count(*) AS rows, count(*) FILTER (status = 'ok') AS scored, count(*) FILTER (status = 'failed') AS failed, "
        "count(*) FILTER (status NOT IN ('ok', 'failed')) AS skipped, "
        + ", ".join(f"round(median({c}) FILTER (status = 'ok'), 9) AS {c}_median" for c in MEDIANS)
        + ", round(quantile_cont(dtw_xh, 0.9::DOUBLE) FILTER (status = 'ok'), 9) AS dtw_xh_p90, "
        + ", ".join(f"CAST(coalesce(sum({c}) FILTER (status = 'ok'), 0) AS BIGINT) AS {c}" for c in V.COUNTERS)
        + """, count(*) FILTER (status = 'ok' AND dtw_reversed_better) AS dtw_reversed_better,
  count(*) FILTER (marks_uncertain) AS marks_uncertain, CAST(sum(lift_delta) FILTER (status = 'ok') AS BIGINT) AS lift_delta_total,
  max(dtw_max_absorption) FILTER (status = 'ok') AS dtw_max_absorption_max, sum(secs) AS secs,
  round(any_value(dtw_xh_worst), 9) AS dtw_xh_worst, any_value(worst_id) AS worst_id
FROM runs JOIN worst USING (side) GROUP BY side""",
    ),
)
def _(spark, d):
    s = R.run_summary(V.run_rows(spark, d), ["side"], MEDIANS, V.COUNTERS)
    for c in [f"{m}_median" for m in MEDIANS] + ["dtw_xh_p90", "dtw_xh_worst"]:
        s = s.withColumn(c, r(c, 9))
    return s


DELTAS = AB + """,
j AS (SELECT a.dtw_xh AS x, b.dtw_xh AS y, b.dtw_xh - a.dtw_xh AS d FROM (SELECT * FROM ra WHERE status = 'ok') a
  JOIN (SELECT * FROM rb WHERE status = 'ok') b USING (id)),
s AS (SELECT count(*) FILTER (d > 1e-9) AS pos, count(*) FILTER (d < -1e-9) AS neg, count(*) AS n_all FROM j)"""
TAIL = """least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0::DOUBLE)))
  FROM (SELECT unnest(range(0, {k} + 1)) AS i)))"""


@query(
    "ag14_paired_comparison",
    V.with_views(
        DELTAS,
        """u AS (SELECT count(*) AS c FROM (SELECT id, status FROM ra WHERE status = 'ok') a FULL OUTER JOIN (SELECT id, status FROM rb WHERE status = 'ok') b USING (id)
  WHERE a.status IS NULL OR b.status IS NULL)""",
        body=f"""SELECT (SELECT count(*) FROM j) AS paired, u.c AS unpaired, (SELECT round(median(d), 9) FROM j) AS delta_median,
  (SELECT round(quantile_cont(d, 0.9::DOUBLE), 9) FROM j) AS delta_p90, (SELECT round(median(d / x) FILTER (x > 0), 9) FROM j) AS rel_median,
  pos + neg AS n, pos, neg, n_all - pos - neg AS ties, round({TAIL.format(n='(pos + neg)', k='least(pos, neg)')}, 5) AS p FROM s, u""",
    ),
)
def _(spark, d):
    c = R.compare_runs(*_ab(spark, d))
    for name in ("delta_median", "delta_p90", "rel_median"):
        c = c.withColumn(name, r(name, 9))
    return c


@query(
    "ag14_gate_pairs",
    V.with_views(
        AB,
        body="""SELECT m.metric, m.a, m.b, m.b - m.a AS delta FROM (
""" + " UNION ALL ".join(
            f"SELECT '{c}' AS metric, (SELECT CAST(sum({c}) AS BIGINT) FROM ra WHERE status = 'ok') AS a, (SELECT CAST(sum({c}) AS BIGINT) FROM rb WHERE status = 'ok') AS b"
            for c in ("marks_missing", "cross_missing", "cross_spurious")
        ) + ") m",
    ),
)
def _(spark, d):
    cols = ["marks_missing", "cross_missing", "cross_spurious"]
    ok = V.run_rows(spark, d).where("status = 'ok' AND side IN ('A', 'R')")
    long = ok.select("side", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in cols])).alias("u"))
    g = long.groupBy("u.metric").agg(
        F.sum(F.when(F.col("side") == "A", F.col("u.v"))).alias("a"),
        F.sum(F.when(F.col("side") == "R", F.col("u.v"))).alias("b"),
    )
    return g.select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


@query(
    "ag15_sign_test",
    V.with_views(
        V.ARMS,
        """
d AS (SELECT b.weight, b.geo_rmse_px - a.geo_rmse_px AS d FROM arms b JOIN arms a USING (specimen, slot) WHERE a.weight = 0),
s AS (SELECT weight, count(*) FILTER (d > 1e-9) AS pos, count(*) FILTER (d < -1e-9) AS neg, count(*) AS n_all FROM d GROUP BY 1)""",
        body=f"""SELECT weight, pos + neg AS n, pos, neg, n_all - pos - neg AS ties,
  CASE WHEN pos + neg > 0 THEN round({TAIL.format(n='(pos + neg)', k='least(pos, neg)')}, 5) END AS p FROM s""",
    ),
)
def _(spark, d):
    arms = V.arm_rows(spark, d)
    base = arms.where("weight = 0").select("specimen", "slot", F.col("geo_rmse_px").alias("g0"))
    deltas = arms.join(base, ["specimen", "slot"]).select("weight", (F.col("geo_rmse_px") - F.col("g0")).alias("delta"))
    return R.sign_counts(deltas, ["weight"], "delta")


ARM_PAIRS = V.ARMS + """,
ap AS (SELECT b.weight, a.accepted AS x, b.accepted AS y, a.geo_rmse_px AS g0, b.geo_rmse_px AS g1, a.cov_rmse_local_px AS c0, b.cov_rmse_local_px AS c1,
  a.off_ink_share AS o0, b.off_ink_share AS o1, a.iterations AS i0, b.iterations AS i1 FROM arms b JOIN arms a USING (specimen, slot) WHERE a.weight = 0),
fl AS (SELECT weight, count(*) FILTER (NOT x AND y) AS gained, count(*) FILTER (x AND NOT y) AS lost FROM ap GROUP BY 1),
mc AS (SELECT weight, gained, lost, CASE WHEN gained + lost = 0 THEN 1.0::DOUBLE ELSE """ + TAIL.format(n="(gained + lost)", k="least(gained, lost)") + """ END AS p FROM fl)"""


def _arm_pairs(spark, d):
    arms = V.arm_rows(spark, d)
    cols = ["accepted", "geo_rmse_px", "cov_rmse_local_px"]
    base = arms.where("weight = 0").select("specimen", "slot", *[F.col(c).alias(f"a_{c}") for c in cols])
    return arms.join(base, ["specimen", "slot"])


@query("ag16_mcnemar", V.with_views(ARM_PAIRS, body="SELECT weight, gained, lost, round(p, 6) AS p FROM mc"))
def _(spark, d):
    return R.mcnemar(_arm_pairs(spark, d), ["weight"], "a_accepted", "accepted").withColumn("p", r("p"))


def _rel_sql(base: str, arm: str, name: str) -> str:
    return f"""
{name}_o AS (SELECT weight, ({arm} - {base}) / {base} AS v, row_number() OVER (PARTITION BY weight ORDER BY ({arm} - {base}) / {base}) - 1 AS k,
  count(*) OVER (PARTITION BY weight) AS n FROM ap WHERE {base} > 0),
{name} AS (SELECT weight, any_value(n) AS n, 100 * median(v) AS median_pct, 100 * max(CASE WHEN k = least(n - 1, floor(0.9::DOUBLE * n)) THEN v END) AS p90_pct,
  count(*) FILTER (v > 1e-12) AS worse, count(*) FILTER (v < -1e-12) AS better FROM {name}_o GROUP BY 1)"""


@query(
    "ag17_relative_change",
    V.with_views(
        ARM_PAIRS,
        _rel_sql("g0", "g1", "rc"),
        body="SELECT weight, n, round(median_pct, 6) AS median_pct, round(p90_pct, 6) AS p90_pct, worse, better FROM rc",
    ),
)
def _(spark, d):
    c = R.relative_change(_arm_pairs(spark, d), ["weight"], "a_geo_rmse_px", "geo_rmse_px")
    return c.withColumn("median_pct", r("median_pct")).withColumn("p90_pct", r("p90_pct"))


@query(
    "ag18_arm_evaluation",
    V.with_views(
        ARM_PAIRS,
        _rel_sql("g0", "g1", "rg"),
        _rel_sql("c0", "c1", "rv"),
        """
mn AS (SELECT weight, count(*) AS n_occurrences, avg(o0) AS off_base, avg(o1) AS off_arm, count(*) FILTER (x) AS accepted_base, count(*) FILTER (y) AS accepted_arm,
  median(i0) AS ib, median(i1) AS ia FROM ap GROUP BY 1),
ow AS (SELECT weight, count(*) FILTER (hit_iteration_cap) AS capped, CAST(sum(n_stranded) AS BIGINT) AS stranded, median(anchor_spike_ratio) AS spike FROM arms GROUP BY 1)""",
        body="""SELECT weight, n_occurrences, round(off_base, 9) AS off_base, round(off_arm, 9) AS off_arm, round(100 * (off_arm - off_base) / off_base, 6) + 0.0 AS benefit_pct,
  100 * (off_arm - off_base) / off_base <= -25 AS benefit_ok, accepted_base, accepted_arm, gained, lost, round(p, 6) AS p,
  round(rg.median_pct, 6) AS geo_median_pct, round(rg.p90_pct, 6) AS geo_p90_pct, round(rv.median_pct, 6) AS cov_median_pct,
  rg.median_pct <= 5 AND rg.p90_pct <= 10 AND rv.median_pct <= 2 AND accepted_arm >= accepted_base AND NOT (lost > gained AND p < 0.05) AS cost_ok,
  ib AS a_iterations_median, ia AS b_iterations_median, capped, stranded, round(spike, 6) AS spike_median
FROM mn JOIN mc USING (weight) JOIN rg USING (weight) JOIN rv USING (weight) JOIN ow USING (weight)""",
    ),
)
def _(spark, d):
    e = R.evaluate_arms(V.arm_rows(spark, d), 0.0, ["specimen", "slot"])
    for c, k in [("off_base", 9), ("off_arm", 9), ("benefit_pct", 6), ("p", 6), ("geo_median_pct", 6), ("geo_p90_pct", 6), ("cov_median_pct", 6), ("spike_median", 6)]:
        e = e.withColumn(c, r(c, k))
    return e


@query(
    "ag19_arm_pools",
    V.with_views(
        V.ARMS,
        body="""SELECT weight, joined, count(*) AS n, round(median(y_fit), 9) AS y_fit_median, round(median(y_target), 9) AS y_target_median,
  round(median(gap_y), 9) + 0.0 AS gap_y_median, round(median(abs(gap_y)), 9) AS gap_abs_median FROM arms WHERE gap_y IS NOT NULL GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    p = R.arm_pools(V.arm_rows(spark, d))
    for c in ("y_fit_median", "y_target_median", "gap_y_median", "gap_abs_median"):
        p = p.withColumn(c, r(c, 9))
    return p


@query(
    "ag19_movement_medians",
    V.with_views(
        V.ARMS,
        body="""SELECT b.weight, round(median(b.y_fit - a.y_fit), 9) + 0.0 AS d_y_fit_median, round(median(b.slot_dy - a.slot_dy), 9) + 0.0 AS d_slot_dy_median
FROM arms b JOIN arms a USING (specimen, slot) WHERE a.weight = 0 GROUP BY 1""",
    ),
)
def _(spark, d):
    m = R.movement_medians(V.arm_rows(spark, d), 0.0, ["specimen", "slot"], ["y_fit", "slot_dy"])
    return m.select("weight", r("d_y_fit_median", 9).alias("d_y_fit_median"), r("d_slot_dy_median", 9).alias("d_slot_dy_median"))


@query(
    "ag19_calibration",
    V.with_views(
        V.ARMS,
        """
l AS (SELECT * FROM (SELECT e_geo, e_landmark, row_number() OVER (PARTITION BY specimen ORDER BY slot DESC) AS rn FROM arms WHERE weight = 0 AND e_landmark > 0) WHERE rn = 1),
o AS (SELECT e_geo / e_landmark AS v, row_number() OVER (ORDER BY e_geo / e_landmark) - 1 AS k, count(*) OVER () AS n FROM l)""",
        body="""SELECT any_value(n) AS n, round(median(v), 9) AS ratio_median, round(max(CASE WHEN k = round_even(0.1::DOUBLE * (n - 1), 0) THEN v END), 9) AS ratio_p10,
  round(max(CASE WHEN k = round_even(0.9::DOUBLE * (n - 1), 0) THEN v END), 9) AS ratio_p90, (SELECT median(e_geo) FROM l) AS e_geo_median,
  (SELECT median(e_landmark) FROM l) AS e_landmark_median FROM o""",
    ),
)
def _(spark, d):
    c = R.calibration(V.arm_rows(spark, d), ["specimen"], "slot")
    for n in ("ratio_median", "ratio_p10", "ratio_p90"):
        c = c.withColumn(n, r(n, 9))
    return c


TERMS = ["off_ink_share", "geo_rmse_px", "cov_rmse_local_px", "y_fit"]


@query(
    "ag20_case_control",
    V.with_views(
        V.ARMS,
        """t AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS term, hit_iteration_cap AS f, {t} AS v FROM arms" for t in TERMS) + ")",
        body="""SELECT term, round(median(v) FILTER (f), 9) AS case_median, round(median(v) FILTER (NOT f), 9) AS control_median,
  count(v) FILTER (f) AS n_case, count(v) FILTER (NOT f) AS n_control FROM t GROUP BY 1""",
    ),
)
def _(spark, d):
    c = R.case_control(V.arm_rows(spark, d), "hit_iteration_cap", TERMS)
    return c.withColumn("case_median", r("case_median", 9)).withColumn("control_median", r("control_median", 9))


@query(
    "ag21_spread",
    V.with_views(
        V.RUNS,
        body="""SELECT side, count(retrace_arc_ratio) AS n, round(median(retrace_arc_ratio), 4) AS median, round(quantile_cont(retrace_arc_ratio, 0.9::DOUBLE), 4) AS p90,
  round(avg(retrace_arc_ratio), 4) AS mean FROM runs WHERE retrace_arc_ratio IS NOT NULL GROUP BY 1""",
    ),
)
def _(spark, d):
    return R.spread(V.run_rows(spark, d), ["side"], "retrace_arc_ratio")


@query(
    "ag22_paired_table",
    V.with_views(
        V.JOINS,
        body="""SELECT pair, count(*) AS n, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b,
  count(*) FILTER (NOT a AND NOT b) AS neither, round(count(*) FILTER (a) / count(*), 3) AS a_rate, round(count(*) FILTER (b) / count(*), 3) AS b_rate
FROM (SELECT pair, base_a_converged AS a, chain_l_converged AS b FROM joinrows) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""",
    ),
)
def _(spark, d):
    return R.paired_table(V.join_rows(spark, d), ["pair"], "base_a_converged", "chain_l_converged")


@query(
    "ag23_gate_failures",
    V.with_views(
        V.JOINS,
        """s AS (SELECT xh_px, chain_l_converged AS c, chain_l_geo_rmse_px AS g, chain_l_cov_rmse_px AS v FROM joinrows UNION ALL
  SELECT xh_px, chain_r_converged, chain_r_geo_rmse_px, chain_r_cov_rmse_px FROM joinrows),
f AS (SELECT coalesce(g > 0.08::DOUBLE * xh_px, false) AS gb, coalesce(v > 0.10::DOUBLE * xh_px, false) AS cb FROM s WHERE coalesce(xh_px, 0) <> 0 AND c = false)""",
        body="""SELECT count(*) AS n, count(*) FILTER (cb AND NOT gb) AS cov_only, count(*) FILTER (gb AND NOT cb) AS geo_only, count(*) FILTER (gb AND cb) AS both,
  count(*) FILTER (NOT gb AND NOT cb) AS neither FROM f""",
    ),
)
def _(spark, d):
    return R.gate_failures(V.join_rows(spark, d))


@query(
    "ag24_per_key_rates",
    V.with_views(
        V.JOINS,
        """s AS (SELECT chain_l_key AS key, base_a_converged AS b, chain_l_converged AS c, coalesce(chain_l_converged_local, chain_l_converged) AS l FROM joinrows UNION ALL
  SELECT chain_r_key, base_b_converged, chain_r_converged, coalesce(chain_r_converged_local, chain_r_converged) FROM joinrows)""",
        body="""SELECT key, count(*) AS n, count(*) FILTER (b) AS base, count(*) FILTER (c) AS chain, count(*) FILTER (l) AS chain_local
FROM s WHERE key IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1""",
    ),
)
def _(spark, d):
    return R.per_key_rates(V.join_rows(spark, d))


@query(
    "ag25_gain_table",
    V.with_views(
        V.JOINS,
        body="SELECT pair, count(*) AS n, count(*) FILTER (chain_connector_yielded) AS gained FROM joinrows WHERE base_empty_join GROUP BY 1",
    ),
)
def _(spark, d):
    return R.gain_table(V.join_rows(spark, d), ["pair"], "base_empty_join", "chain_connector_yielded")


MOVE = AB + """,
mv AS (SELECT id, CASE WHEN a.status = 'ok' AND b.status = 'ok' THEN 'scored' WHEN coalesce(a.status, 'missing') <> coalesce(b.status, 'missing') THEN 'mismatched' ELSE 'unscored' END AS state,
  b.marks_missing + b.cross_missing - a.marks_missing - a.cross_missing AS dt, b.aiou - a.aiou AS ds, a.marks_missing = b.marks_missing AND a.cross_missing = b.cross_missing AND a.touch_ref = b.touch_ref AS same
  FROM ra a FULL OUTER JOIN rb b USING (id))"""


def _movement(spark, d):
    a, b = (
        x.select(
            "id",
            "status",
            (F.col("marks_missing") + F.col("cross_missing")).alias("target_dist"),
            F.col("aiou").alias("score"),
            F.array("marks_missing", "cross_missing", "touch_ref").alias("content"),
        )
        for x in _ab(spark, d)
    )
    return R.movement(a, b)


@query(
    "ag27_movement_classes",
    V.with_views(
        MOVE,
        body="""SELECT state, CASE WHEN state = 'scored' THEN CASE WHEN dt < 0 THEN 'better' WHEN dt > 0 THEN 'worse' ELSE 'same' END END AS target_class,
  CASE WHEN state = 'scored' THEN CASE WHEN same THEN 'identical' ELSE 'moved' END END AS content_class, count(*) AS n,
  count(*) FILTER (state = 'scored' AND ds < -0.003) AS losers FROM mv GROUP BY 1, 2, 3""",
    ),
)
def _(spark, d):
    m = _movement(spark, d)
    return m.groupBy("state", "target_class", "content_class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("loser").alias("losers")
    )


def _bench(spark, d, flag=None):
    rows = V.run_rows(spark, d, flag)
    return rows.select("side", "id", F.col("dtw_xh").alias("loss"), F.col("aiou").alias("coverage"), F.col("retrace_arc_ratio").alias("transition"))


@query(
    "ag28_penalised_block",
    V.with_views(
        V.RUNS,
        body="""SELECT r.side, count(*) AS n, count(dtw_xh) AS n_scored, round(avg(coalesce(dtw_xh, 1)), 6) AS loss, round(avg(aiou) FILTER (dtw_xh IS NOT NULL), 6) AS coverage_mean,
  round(avg(retrace_arc_ratio) FILTER (dtw_xh IS NOT NULL), 6) AS transition_mean, any_value(w.id) AS worst_id, any_value(w.l) AS worst_loss
FROM runs r JOIN (SELECT side, id, coalesce(dtw_xh, 1) AS l, row_number() OVER (PARTITION BY side ORDER BY coalesce(dtw_xh, 1) DESC, id) AS rn FROM runs) w ON w.side = r.side AND rn = 1 GROUP BY 1""",
    ),
)
def _(spark, d):
    b = R.penalised_block(_bench(spark, d), ["side"], ["coverage", "transition"])
    for c in ("loss", "coverage_mean", "transition_mean"):
        b = b.withColumn(c, r(c))
    return b


@query(
    "ag28_component_moves",
    V.with_views(
        AB,
        """m AS (SELECT id, b.dtw_xh - a.dtw_xh AS loss_delta, b.aiou - a.aiou AS mc, b.retrace_arc_ratio - a.retrace_arc_ratio AS mt FROM ra a JOIN rb b USING (id))""",
        body="""SELECT id, round(loss_delta, 9) + 0.0 AS loss_delta, CASE WHEN mc IS NULL AND mt IS NULL THEN NULL WHEN mt IS NULL OR abs(mc) >= abs(mt) THEN 'coverage' ELSE 'transition' END AS component,
  round(CASE WHEN mt IS NULL OR abs(mc) >= abs(mt) THEN mc ELSE mt END, 9) + 0.0 AS move FROM m""",
    ),
)
def _(spark, d):
    m = R.biggest_component_move(_bench(spark, d, "A"), _bench(spark, d, "R"), ["coverage", "transition"])
    return m.withColumn("loss_delta", r("loss_delta", 9)).withColumn("move", r("move", 9))


@query(
    "ag29_reason_rollup",
    V.with_views(
        V.RUNS,
        body="SELECT side AS kind, status AS gate, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY side), 9) AS share FROM runs GROUP BY 1, 2",
    ),
)
def _(spark, d):
    rows = V.run_rows(spark, d).select(F.col("side").alias("kind"), F.col("status").alias("gate"))
    return R.reason_rollup(rows, "kind", "gate").withColumn("share", r("share", 9))


@query(
    "ag29_moved_summary",
    V.with_views(
        V.RUNS,
        body="""SELECT count(*) FILTER (status = 'ok') AS moved, count(*) FILTER (status <> 'ok') AS refused, max(secs) FILTER (status = 'ok') AS max_shift,
  median(secs) FILTER (status = 'ok') AS median_shift FROM runs""",
    ),
)
def _(spark, d):
    rows = V.run_rows(spark, d).select("secs", F.when(F.col("status") != "ok", F.col("status")).alias("reason"))
    return R.moved_summary(rows, "secs", "reason")


@query(
    "ag45_any_first",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn FROM part)
SELECT p_brand, bool_or(p_retailprice > 950) AS any_dear, max(CASE WHEN rn = 1 THEN p_name END) AS smallest, count(*) AS n FROM p GROUP BY 1""",
)
def _(spark, d):
    p = V.table(spark, d, "part")
    return p.groupBy("p_brand").agg(
        F.bool_or(F.col("p_retailprice") > 950).alias("any_dear"),
        F.min_by("p_name", F.struct("p_size", "p_partkey")).alias("smallest"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "ag46_badness",
    V.with_views(
        V.RUNS,
        body="""SELECT side, id, round(10 * marks_missing + CASE WHEN dtw_xh IS NULL THEN 0 ELSE (dtw_xh + aiou) / 2 END, 9) AS badness FROM runs WHERE marks_missing IS NOT NULL""",
    ),
)
def _(spark, d):
    rows = V.run_rows(spark, d).where("marks_missing IS NOT NULL")
    m = F.when(F.col("dtw_xh").isNotNull(), F.create_map(F.lit("loss"), F.col("dtw_xh"), F.lit("cov"), F.col("aiou")))
    return rows.select("side", "id", r(R.badness(F.col("marks_missing"), m), 9).alias("badness"))


@query(
    "ag48_sorted_groups",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders""",
)
def _(spark, d):
    from traceframe.functions.ordered import dense_rank_of

    o = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    ranked = dense_rank_of(o, ["o_custkey"], "o_totalprice", "o_orderkey", "place", descending=True, start=1)
    return ranked.select("o_custkey", "o_orderkey", "place")


@query(
    "sm13_safe_round",
    """SELECT s_suppkey, CASE WHEN s_acctbal > 9000 OR s_acctbal < -500 THEN NULL ELSE round(s_acctbal / 7, 3) + 0.0 END AS safe FROM supplier""",
)
def _(spark, d):
    v = (
        F.when(F.col("s_acctbal") > 9000, F.lit(float("inf")))
        .when(F.col("s_acctbal") < -500, F.lit(float("nan")))
        .otherwise(F.col("s_acctbal") / 7)
    )
    return V.table(spark, d, "supplier").select("s_suppkey", (safe_round(v) + F.lit(0.0)).alias("safe"))


JN5 = V.PAIRS + """,
jm AS (SELECT c.user_id AS case_id, c.slot AS from_slot, c.dx, c.dy, c.seq % 19 = 0 AS override, m.seq AS mseq, m.left_key, m.right_key, m.fit_ok, m.dx AS ox, m.good_geometry AS mg,
    c.left_key AS cl, c.right_key AS cr, c.good_geometry AS cg
  FROM tr c LEFT JOIN (SELECT * FROM tr WHERE seq % 6 <> 0) m ON m.user_id = c.user_id AND m.slot = c.slot + 1),
jo AS (SELECT *, CASE WHEN override THEN 'excluded_override' WHEN mseq IS NULL OR left_key <> cr OR right_key <> cl THEN 'unmatched'
  WHEN NOT coalesce(fit_ok, false) THEN 'excluded_fit' WHEN NOT cg OR NOT mg THEN 'unmatched' ELSE 'matched' END AS outcome FROM jm)"""


@query(
    "jn05_measured_vs_made",
    V.with_views(
        JN5,
        body="""SELECT case_id, count(*) AS n_joins, count(*) FILTER (outcome = 'matched') AS n_matched, count(*) FILTER (outcome = 'excluded_fit') AS excluded_fit,
  count(*) FILTER (outcome = 'excluded_override') AS excluded_override, round(avg(round(abs(dx - ox), 3)) FILTER (outcome = 'matched'), 3) AS doff_mean FROM jo GROUP BY 1""",
    ),
)
def _(spark, d):
    t = V.transitions(spark, d).withColumnRenamed("user_id", "case_id")
    composed = t.select(
        "case_id",
        F.col("slot").alias("from_slot"),
        (F.col("seq") % 19 == 0).alias("override"),
        F.lit(0.0).alias("body_exit_x"),
        F.col("offset.x").alias("body_entry_x"),
        F.col("connector").alias("made_points"),
    )
    measured = t.where(F.col("seq") % 6 != 0).select(
        "case_id", (F.col("slot") - 1).alias("slot"), "left_key", "right_key", "fit_ok", F.col("offset.x").alias("offset_x"), F.col("connector").alias("points")
    )
    slots = t.select("case_id", "slot", F.col("right_key").alias("key"), F.col("left_key").alias("next_key"))
    j = R.compare_joins(composed, measured, slots)
    return j.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_joins"),
        *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("matched", "n_matched"), ("excluded_fit", "excluded_fit"), ("excluded_override", "excluded_override"))],
        F.round(F.avg("doff"), 3).alias("doff_mean"),
    )


@query(
    "so01_union_batches",
    """SELECT side, count(*) AS n, count(detail) AS n_detail FROM (SELECT 'order' AS side, NULL AS detail FROM orders UNION ALL SELECT 'event', props FROM events) GROUP BY 1""",
)
def _(spark, d):
    o = V.table(spark, d, "orders").select(F.lit("order").alias("side"))
    e = V.table(spark, d, "events").select(F.lit("event").alias("side"), F.col("props").alias("detail"))
    return o.unionByName(e, allowMissingColumns=True).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.count("detail").alias("n_detail")
    )


@query(
    "so02_id_set_algebra",
    V.with_views(
        AB,
        """a AS (SELECT id FROM ra WHERE status = 'ok'), b AS (SELECT id FROM rb WHERE status = 'ok')""",
        body="""SELECT 'except' AS op, id FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'intersect', id FROM (SELECT id FROM a INTERSECT SELECT id FROM b)
UNION ALL SELECT 'symmetric', id FROM ((SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a))""",
    ),
)
def _(spark, d):
    a, b = (x.where("status = 'ok'").select("id") for x in _ab(spark, d))
    a_only, b_only = a.exceptAll(b), b.exceptAll(a)
    return (
        a_only.select(F.lit("except").alias("op"), "id")
        .unionByName(a.intersect(b).select(F.lit("intersect").alias("op"), "id"))
        .unionByName(a_only.unionByName(b_only).select(F.lit("symmetric").alias("op"), "id"))
    )


@query(
    "so03_content_dedupe",
    """SELECT min(doc_id) AS kept, count(*) AS covered, count(*) - 1 AS dropped FROM documents GROUP BY sha256(text), lang""",
)
def _(spark, d):
    docs = V.table(spark, d, "documents")
    return R.content_dedupe(docs, ["text", "lang"], "doc_id").drop("digest")


@query(
    "so03_covered_keys",
    """SELECT min(doc_id) OVER (PARTITION BY sha256(text), lang) AS kept, doc_id AS covered FROM documents""",
)
def _(spark, d):
    return R.covered_keys(V.table(spark, d, "documents"), ["text", "lang"], "doc_id")


@query(
    "so04_merged_boxes",
    """WITH b AS (SELECT l_suppkey AS source, l_partkey % 50 AS key, l_linenumber % 3 AS priority, l_orderkey * 10 + l_linenumber AS id, l_quantity AS x0, l_returnflag = 'R' AND l_linestatus = 'F' AS locked FROM lineitem)
SELECT source, key, m.id AS id, m.x0 AS x0, locked FROM (SELECT source, key, min({'priority': priority, 'id': id, 'x0': x0}) AS m, bool_or(locked) AS locked FROM b GROUP BY 1, 2)""",
)
def _(spark, d):
    li = V.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("key"), (F.col("l_linenumber") % 3).alias("priority"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x0"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("locked"),
    )
    return R.merged_boxes(li, ["source", "key"], ["priority", "id", "x0"], "locked").drop("priority")


@query(
    "so04_sibling_collapse",
    """WITH s AS (SELECT p_brand || '/' || p_type AS key, p_size % 3 AS priority, p_size % 10 AS content, p_partkey AS variant FROM part),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, content ORDER BY priority, variant) AS d FROM s) WHERE d = 1)
SELECT key, content, variant, CASE WHEN r = 1 THEN variant ELSE top + r - 1 END AS new_variant FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority, variant) AS r, max(variant) OVER (PARTITION BY key) AS top FROM f)""",
)
def _(spark, d):
    p = V.table(spark, d, "part").select(
        F.concat_ws("/", "p_brand", "p_type").alias("key"),
        (F.col("p_size") % 3).alias("priority"),
        (F.col("p_size") % 10).alias("content"),
        F.col("p_partkey").alias("variant"),
    )
    c = R.collapse_siblings(p, ["key"], "priority", "content", "variant")
    return c.select("key", "content", "variant", "new_variant")


@query(
    "tk02_top_movers",
    V.with_views(
        AB,
        body="""SELECT id, round(b.aiou - a.aiou, 9) + 0.0 AS move FROM ra a JOIN rb b USING (id) ORDER BY abs(b.aiou - a.aiou) DESC NULLS LAST, id LIMIT 25""",
    ),
)
def _(spark, d):
    a, b = _ab(spark, d)
    j = R.paired(a, b, ["id"], ["aiou"]).withColumn("move", F.col("b_aiou") - F.col("a_aiou"))
    return R.top_n(j, [F.abs("move").desc_nulls_last(), F.col("id")], 25).select("id", r("move", 9).alias("move"))


@query(
    "tk03_manifest_order",
    """WITH m AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier WHERE s_acctbal > 0),
j AS (SELECT s_suppkey, rank FROM supplier LEFT JOIN m USING (s_suppkey))
SELECT s_suppkey, row_number() OVER (ORDER BY rank IS NULL, coalesce(rank, s_suppkey)) AS place FROM j""",
)
def _(spark, d):
    from traceframe.functions.ordered import dense_rank_of

    s = V.table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    manifest = dense_rank_of(s.where("s_acctbal > 0"), [], "s_acctbal", "s_suppkey", "rank", descending=True, start=1)
    o = R.manifest_order(s, manifest, "s_suppkey", "s_suppkey")
    flat = o.select("s_suppkey", F.col("order_key.o").alias("o"), F.col("order_key.p").alias("p"))
    return dense_rank_of(flat, [], "o", "p", "place", start=1).select("s_suppkey", "place")


@query(
    "tk05_composite_sort",
    V.with_views(
        V.RUNS,
        body="SELECT side, id, round(retrace_arc_ratio, 9) AS dev FROM runs ORDER BY retrace_arc_ratio DESC NULLS FIRST, side, id LIMIT 40",
    ),
)
def _(spark, d):
    rows = V.run_rows(spark, d)
    top = R.top_n(rows, [F.col("retrace_arc_ratio").desc_nulls_first(), F.col("side"), F.col("id")], 40)
    return top.select("side", "id", r("retrace_arc_ratio", 9).alias("dev"))


@query(
    "wn04_best_per_group",
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderpriority, o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _(spark, d):
    o = V.table(spark, d, "orders")
    return R.cap_per_group(
        o, ["o_custkey"], [F.col("o_orderstatus") != "F", F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderkey")], 1
    ).select("o_custkey", "o_orderkey")


@query(
    "wn05_cap_per_group",
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 3""",
)
def _(spark, d):
    o = V.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return R.cap_per_group(o, ["o_custkey"], [F.col("o_orderkey")], 3)


@query(
    "wn16_stride_sample",
    """WITH s AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, doc_id FROM s WHERE k % greatest(1, n // 12) = 0""",
)
def _(spark, d):
    from traceframe.functions.ordered import dense_rank_of

    docs = V.table(spark, d, "documents").select("lang", "doc_id")
    n = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    ranked = dense_rank_of(docs, ["lang"], "doc_id", "doc_id", "k").join(n, "lang")
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / 12))
    return ranked.where(F.col("k") % stride == 0).select("lang", "doc_id")


@query(
    "dt01_stamps",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stamp, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y%m%dT%H%M%SZ') END AS closed_at FROM orders""",
)
def _(spark, d):
    o = V.table(spark, d, "orders")
    stamp = F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'")
    return o.select("o_orderkey", stamp.alias("stamp"), F.when(F.col("o_orderstatus") == "F", stamp).alias("closed_at"))


@query(
    "js01_nested_default",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""",
)
def _(spark, d):
    v = F.try_parse_json("props")
    return V.table(spark, d, "events").select(
        "event_id",
        F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.lit(-1)).alias("k"),
        F.coalesce(F.try_variant_get(v, "$.missing", "string"), F.lit("none")).alias("missing"),
    )
