"""Queries for projections, predicates, triage and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions.stats import r
from traceframe.operators import checks as C
from traceframe.plans import views as V
from traceframe.plans.registry import query


@query("pr01_narrow_listing", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")


@query(
    "pr02_json_object",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 5 = 0 AS not_an_object FROM events""",
)
def _(spark, d):
    e = V.table(spark, d, "events")
    # every fifth value is wrapped into an array, which is not an object
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    obj = F.when(F.substring(F.ltrim(raw), 1, 1) == "{", F.from_json(raw, "k BIGINT"))
    return e.select("event_id", obj["k"].alias("k"), obj.isNull().alias("not_an_object"))


@query(
    "pr03_optional_filters",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
)
def _(spark, d):
    o = C.matching(V.table(spark, d, "orders"), o_orderstatus="F", o_custkey=None, o_orderpriority="1-URGENT")
    return o.select("o_orderkey").orderBy("o_orderkey")


@query(
    "pr04_key_lookup",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount > 0.05::DOUBLE AND (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.07::DOUBLE)""",
)
def _(spark, d):
    li = V.table(spark, d, "lineitem").withColumn("approved", F.col("l_discount") > 0.05)
    keys = li.where((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07))
    return C.key_lookup(li, keys, ["l_partkey", "l_suppkey"], approved_only=True).select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    "pr05_unknown_keys",
    "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def _(spark, d):
    known = V.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return C.unknown_keys(V.table(spark, d, "orders").select(F.col("o_custkey").alias("key")), known, "key")


@query(
    "pr06_key_identity",
    """WITH reg AS (SELECT n_name AS text, n_nationkey AS key FROM nation WHERE n_nationkey < 20),
rws AS (SELECT c_custkey, 'NATION_' || (c_nationkey + CASE WHEN c_custkey % 10 = 3 THEN 1 ELSE 0 END) AS text, c_nationkey AS key FROM customer)
SELECT c_custkey, r.text, r.key, reg.key AS expected FROM rws r LEFT JOIN reg ON reg.text = r.text
WHERE CASE WHEN reg.key IS NOT NULL THEN reg.key <> r.key ELSE r.key < 20 END""",
)
def _(spark, d):
    reg = V.table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_name").alias("text"), F.col("n_nationkey").alias("key"))
    shift = F.when(F.col("c_custkey") % 10 == 3, 1).otherwise(0)
    rows = V.table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), (F.col("c_nationkey") + shift).cast("string")).alias("text"), F.col("c_nationkey").alias("key")
    )
    return C.key_mismatch(rows, reg, "key", "text").select("c_custkey", "text", "key", "expected")


def _nested_strokes(spark, d):
    """Order lines as nested strokes: one stroke per order, one point per line, some of them broken."""
    li = V.table(spark, d, "lineitem")
    price = F.col("l_extendedprice") / 1000
    pt = F.struct(
        F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("k"),
        F.col("l_quantity").alias("x"),
        F.when(F.col("l_tax") < 0.08, price).alias("y"),
    )
    # an order has a handful of lines, so its nested stroke is small
    s = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(pt)).alias("p"))
    pts = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return s.select("l_orderkey", F.array(pts).alias("strokes"))


@query(
    "pr07_stroke_bounds",
    """SELECT l_orderkey, CASE WHEN count(*) < 2 THEN 'stroke 0: points' WHEN count(*) FILTER (l_tax >= 0.08::DOUBLE) > 0 THEN 'stroke 0: coordinate'
  WHEN max(l_extendedprice / 1000) > 100 OR max(l_quantity) > 100 THEN 'stroke 0: range' END AS reason FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    return _nested_strokes(spark, d).select("l_orderkey", C.stroke_violation(F.col("strokes")).alias("reason"))


@query(
    "pr08_stale_frame",
    """SELECT l_orderkey, l_linenumber, CASE WHEN o.o_orderkey IS NULL THEN 'no_entry' WHEN l_tax = 0 THEN 'no_registration'
  WHEN abs(l_quantity + l_linenumber - 25) > 4 THEN 'baseline' WHEN abs(l_discount * 100 - 5) > 0.51 THEN 'xheight' END AS reason
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey""",
)
def _(spark, d):
    o = V.table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    j = V.table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    reason = C.stale_reason(
        F.col("o_orderkey"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity")),
        F.col("l_linenumber").cast("double"),
        F.col("l_discount") * 100,
        F.lit(25.0),
        F.lit(5.0),
    )
    return j.select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query(
    "pr09_triage_counts",
    V.with_views(
        V.OCC,
        body="""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_points < 32 THEN 'no_anchors' WHEN geo_rmse_px IS NULL THEN 'specimen_not_measured'
  WHEN seq % 6 = 1 THEN 'derived_variant' ELSE 'kept' END AS reason FROM occ) GROUP BY 1""",
    ),
)
def _(spark, d):
    kept, dropped = C.triage(
        V.occurrences(spark, d),
        [
            ("no_anchors", F.size("anchors") < 32),
            ("specimen_not_measured", F.col("geo_rmse_px").isNull()),
            ("derived_variant", F.col("seq") % 6 == 1),
        ],
    )
    return dropped.unionByName(kept.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n")))


@query(
    "pr10_gate_cascade",
    """SELECT gate, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 7 OR l_linestatus = 'O' AND l_linenumber = 1 THEN 'not_converged_local' WHEN l_discount > 0.08::DOUBLE THEN 'geo_rmse'
  WHEN l_tax = 0 THEN 'at_bound' WHEN l_quantity < 5 THEN 'anchor_count' WHEN l_quantity / 5 > 8 THEN 'anchor_spike' WHEN l_returnflag = 'R' THEN 'connector_degenerate' ELSE 'ok' END AS gate FROM lineitem) GROUP BY 1""",
)
def _(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, ~((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1))).alias("converged_local"),
        F.col("l_discount").alias("geo_rmse_px"),
        (F.col("l_tax") == 0).alias("at_bound"),
        (F.col("l_quantity") >= 5).alias("anchors_ok"),
        (F.col("l_quantity") / 5).alias("spike_ratio"),
        F.when(F.col("l_returnflag") == "R", F.lit("seam_share")).alias("connector_reason"),
    )
    return rows.select(C.letter_gate(F.lit(0.08)).alias("gate")).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def _connector_segments(spark, d):
    """Connectors of the transitions as two segments each; a single point is two segments without length."""
    t = V.transitions(spark, d)
    point = lambda i: F.coalesce(F.get("connector", F.lit(i)), F.get("connector", F.lit(0)))

    def seg(i: int):
        a, b = point(i), point(i + 1)
        return F.struct(F.lit(i).alias("pos"), a["x"].alias("x0"), (a["y"] / 100).alias("y0"), b["x"].alias("x1"), (b["y"] / 100).alias("y1"))

    s = t.select("seq", (F.col("offset.x") * 0.3).alias("a_max_x"), (F.col("offset.x") * 0.6).alias("b_min_x"), F.lit(2.0).alias("xh"), F.explode(F.array(seg(0), seg(1))).alias("s"))
    return s.select("seq", "a_max_x", "b_min_x", "xh", "s.*")


@query(
    "pr11_connector_quality",
    V.with_views(
        V.PAIRS,
        """
c AS (SELECT seq, dx, dx * 0.3::DOUBLE AS a, dx * 0.6::DOUBLE AS b, dy / 100 AS y2, (dy + 1) / 100 AS y1, sqrt((dx / 2) ** 2 + ((dy + 1) / 100) ** 2) AS l1,
  sqrt((dx / 2) ** 2 + ((dy + 1) / 100 - dy / 100) ** 2) AS l2 FROM tr WHERE good_geometry),
s AS (SELECT seq, (l1 + l2) / 2 AS arc, sqrt(dx ** 2 + y2 ** 2) / 2 AS chord, dx / 2 AS net_dx, CASE WHEN dx = 0 THEN 0 ELSE l1 * 0.6::DOUBLE / 2 END AS seam_left,
  CASE WHEN dx = 0 THEN 0 ELSE l2 * 0.8::DOUBLE / 2 END AS seam_right, greatest(0, (b - a) / 2) AS gap FROM c WHERE l1 + l2 > 0)""",
        body="""SELECT coalesce(CASE WHEN chord < 0.25 THEN NULL WHEN seam_left + seam_right > 1.3 THEN 'seam_share' WHEN net_dx / arc < 0 THEN 'backward_arc'
  WHEN arc / (gap + 0.8) > 2 THEN 'arc_vs_gap' WHEN arc / chord <= 1.02 AND arc >= 1 THEN 'straight_long' END, 'none') AS reason, count(*) AS n,
  round(avg(arc), 6) AS arc, round(avg(seam_left), 6) AS seam_left, round(avg(seam_right), 6) AS seam_right FROM s GROUP BY 1""",
    ),
)
def _(spark, d):
    sig = C.connector_signals(_connector_segments(spark, d), ["seq"])
    return sig.groupBy(F.coalesce(C.connector_reason(), F.lit("none")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), *[r(F.avg(c)).alias(c) for c in ("arc", "seam_left", "seam_right")]
    )


def item_changes(spark, d):
    """Orders as stored work items and their events as changes (event user = order key)."""
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey")
    stored = o.select(
        k.alias("item_id"),
        F.struct(
            F.when(k % 4 == 0, "note").otherwise("glyph").alias("kind"),
            F.when(F.col("o_orderstatus") == "F", "ack").otherwise("open").alias("status"),
            F.when(k % 3 == 0, "clear").when(k % 3 == 1, " ").alias("understanding"),
            F.when(k % 5 == 0, "yes").alias("reproduced"),
            F.when(k % 2 == 0, "fit").alias("stage"),
            F.lit(None).cast("string").alias("resolution"),
        ).alias("s"),
    )
    e = V.table(spark, d, "events")
    t, m = F.col("event_type"), F.col("event_id")
    change = e.select(
        (m % 1500).alias("item_id"),
        m.alias("change_id"),
        F.struct(
            F.when(t == "signup", "ack").when(t == "purchase", "done").when(t == "error", "returned").when(t == "view", "open").alias("status"),
            F.when((t == "signup") & (m % 3 != 0), "I see").when((t == "click") & (m % 4 == 0), "sneaked").alias("understanding"),
            F.when((t == "signup") & (m % 5 != 0), "yes").alias("reproduced"),
            F.when((t == "purchase") & (m % 2 == 0), "compose").alias("stage"),
            F.when(t.isin("purchase", "error") & (m % 7 != 0), F.when(m % 11 == 0, "  ").otherwise("fixed")).alias("resolution"),
        ).alias("c"),
    )
    return stored, change


ITEMS = """
st AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 4 = 0 THEN 'note' ELSE 'glyph' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 'ack' ELSE 'open' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN 'clear' WHEN o_orderkey % 3 = 1 THEN ' ' END AS understanding, CASE WHEN o_orderkey % 5 = 0 THEN 'yes' END AS reproduced,
  CASE WHEN o_orderkey % 2 = 0 THEN 'fit' END AS stage, CAST(NULL AS VARCHAR) AS resolution FROM orders),
ch AS (SELECT event_id % 1500 AS item_id, event_id AS change_id,
  CASE event_type WHEN 'signup' THEN 'ack' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'returned' WHEN 'view' THEN 'open' END AS c_status,
  CASE WHEN event_type = 'signup' AND event_id % 3 <> 0 THEN 'I see' WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'sneaked' END AS c_understanding,
  CASE WHEN event_type = 'signup' AND event_id % 5 <> 0 THEN 'yes' END AS c_reproduced, CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'compose' END AS c_stage,
  CASE WHEN event_type IN ('purchase', 'error') AND event_id % 7 <> 0 THEN CASE WHEN event_id % 11 = 0 THEN '  ' ELSE 'fixed' END END AS c_resolution FROM events)"""


@query(
    "pr12_transition_rule",
    V.with_views(
        ITEMS,
        body="""SELECT change_id, CASE
  WHEN coalesce(c_status, 'open') NOT IN ('ack', 'done', 'returned') AND coalesce(c_understanding, c_reproduced, c_stage, c_resolution) IS NOT NULL THEN 'protocol_without_transition'
  WHEN c_status IN ('done', 'returned') AND regexp_full_match(coalesce(understanding, ''), '[[:space:]]*') THEN 'not_understood'
  WHEN c_status = 'ack' AND (regexp_full_match(coalesce(c_understanding, understanding, ''), '[[:space:]]*') OR regexp_full_match(coalesce(c_reproduced, reproduced, ''), '[[:space:]]*')) THEN 'ack_missing'
  WHEN c_status IN ('done', 'returned') AND (regexp_full_match(coalesce(c_resolution, resolution, ''), '[[:space:]]*') OR kind <> 'note' AND regexp_full_match(coalesce(c_stage, stage, ''), '[[:space:]]*')) THEN 'close_missing' END AS problem
FROM ch JOIN st USING (item_id)""",
    ),
)
def _(spark, d):
    stored, change = item_changes(spark, d)
    return change.join(stored, "item_id").select("change_id", C.transition_problem().alias("problem"))


def _payload(spark, d, flag):
    li = V.table(spark, d, "lineitem").where(V.pair_side() == flag)
    return li.groupBy(
        F.col("l_suppkey").alias("key"), F.col("l_linestatus").alias("item"), F.col("l_linenumber").alias("i")
    ).agg((F.sum(F.round(F.col("l_tax") * 100).cast("bigint")) / F.count(F.lit(1))).alias("v"))


PAYLOAD = f"""
pay AS (SELECT {V.PAIR_SIDE} AS side, l_suppkey AS key, l_linestatus AS item, l_linenumber AS i, sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
pj AS (SELECT key, item, i, a.v AS a, b.v AS b FROM (SELECT * FROM pay WHERE side = 'A') a FULL OUTER JOIN (SELECT * FROM pay WHERE side = 'R') b USING (key, item, i))"""


@query(
    "pr13_payload_difference",
    V.with_views(
        PAYLOAD,
        body="""SELECT key, item, count(a) AS n_a, count(b) AS n_b, round(max(abs(a - b)), 9) AS max_dev, CASE WHEN count(a) = 0 THEN 'missing_a' WHEN count(b) = 0 THEN 'missing_b'
  WHEN count(*) FILTER (a IS NULL OR b IS NULL) > 0 THEN 'length' WHEN max(abs(a - b)) > 2 THEN 'deviates' END AS problem FROM pj GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    diff = C.payload_difference(_payload(spark, d, "A"), _payload(spark, d, "R"), ["key"], 2.0)
    return diff.withColumn("max_dev", r("max_dev", 9))


@query(
    "pr13_shape_and_placement",
    V.with_views(
        PAYLOAD,
        body="""SELECT p.key, p.item, round(max(abs(a - b)), 9) AS placement, round(max(abs(a - b - m)), 9) AS shape FROM pj p
JOIN (SELECT key, item, median(a - b) AS m FROM pj GROUP BY 1, 2) q ON q.key = p.key AND q.item = p.item WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    from traceframe.functions.quantiles import exact_quantiles

    a = _payload(spark, d, "A").withColumnRenamed("v", "a")
    j = a.join(_payload(spark, d, "R").withColumnRenamed("v", "b"), ["key", "item", "i"]).withColumn("delta", F.col("a") - F.col("b"))
    med = exact_quantiles(j, ["key", "item"], "delta", {"m": 0.5})
    return j.join(med, ["key", "item"]).groupBy("key", "item").agg(
        r(F.max(F.abs("delta")), 9).alias("placement"), r(F.max(F.abs(F.col("delta") - F.col("m"))), 9).alias("shape")
    )


@query(
    "pr14_split_selection",
    """SELECT doc_id, CASE WHEN b.item_id IS NOT NULL THEN 'dev' ELSE 'confirm' END AS split FROM documents LEFT JOIN benchmark b ON b.item_id = doc_id""",
)
def _(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id")
    frozen = V.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    dev = docs.join(frozen, "doc_id", "left_semi").withColumn("split", F.lit("dev"))
    return dev.unionByName(docs.join(frozen, "doc_id", "left_anti").withColumn("split", F.lit("confirm")))


@query(
    "pr14_missing_from_set",
    """SELECT doc_id, CASE WHEN d.doc_id IS NULL THEN 'not_in_table' WHEN l.quality = 0 THEN 'low_quality' END AS why FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d USING (doc_id)
WHERE d.doc_id IS NULL OR l.quality = 0""",
)
def _(spark, d):
    en = V.table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.lit(True).alias("_in"))
    j = V.table(spark, d, "labels").join(en, "doc_id", "left")
    why = C.first_reason([("not_in_table", F.col("_in").isNull()), ("low_quality", F.col("quality") == 0)])
    return j.select("doc_id", why.alias("why")).where("why IS NOT NULL")


@query(
    "pr15_inheritance",
    """SELECT c_custkey, c_nationkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, n_name) AS resolved,
  nullif(coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, n_name), n_name) AS exported FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def _(spark, d):
    c = V.table(spark, d, "customer")
    n = V.table(spark, d, "nation")
    own = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).withColumn("resolved", C.inherit(own, F.col("n_name")))
    return j.select("c_custkey", "c_nationkey", "resolved", C.uninherit(F.col("resolved"), F.col("n_name")).alias("exported"))


ZERO, FALSY = ["delta"], ["marks_ambiguous", "lift_delta"]


@query(
    "pr16_identity_gate",
    V.with_views(
        V.RUNS,
        body="""SELECT id, 'status ' || status AS problem, CAST(NULL AS DOUBLE) AS value FROM runs WHERE status <> 'ok'
UNION ALL SELECT id, 'marks_ambiguous', CAST(marks_ambiguous AS DOUBLE) FROM runs WHERE status = 'ok' AND marks_ambiguous <> 0
UNION ALL SELECT id, 'lift_delta', CAST(lift_delta AS DOUBLE) FROM runs WHERE status = 'ok' AND lift_delta <> 0""",
    ),
)
def _(spark, d):
    rows = V.run_rows(spark, d).withColumn("delta", F.col("dtw_xh") - F.col("dtw_xh"))
    return C.identity_violations(rows, "id", ZERO, FALSY)


@query(
    "pr16_self_comparison",
    V.with_views(V.TRACE, body="SELECT DISTINCT case_id * 100 + stroke AS case_id, CAST(0 AS BIGINT) AS violations FROM trace"),
)
def _(spark, d):
    """Every week against itself: alignment, both chamfer halves, matches and position errors have to be exactly zero."""
    from traceframe.operators import compare as Cm
    from traceframe.operators import matching as M
    from traceframe.session import checkpointed

    t = V.traces(spark, d).select((F.col("case_id") * 100 + F.col("stroke")).alias("case_id"), F.col("pos").cast("bigint").alias("i"), "x", "y")
    t = checkpointed(t)
    ref, cand = t.withColumnRenamed("i", "ref"), t.withColumnRenamed("i", "cand")
    counts = M.match_counts(ref, cand, checkpointed(M.greedy_one_to_one(ref, cand, ["case_id"], 0.1)), ["case_id"])
    rows = Cm.dtw(t, t, ["case_id"]).join(Cm.chamfer(t, t, ["case_id"], 0.25), "case_id").join(counts.drop("ambiguous"), "case_id")
    rows = rows.withColumn("status", F.lit("ok"))
    bad = C.identity_violations(rows, "case_id", ["dtw", "a_to_b", "b_to_a", "median_error", "missing", "spurious"], ["reversed_better"])
    return rows.select("case_id").join(bad, "case_id", "left").groupBy("case_id").agg(F.count("problem").alias("violations"))


@query(
    "pr17_row_reshaping",
    """SELECT o_orderkey AS uid, o_orderstatus AS glyph, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_orderpriority END AS note, '{}' AS meta FROM orders""",
)
def _(spark, d):
    o = V.table(spark, d, "orders").withColumn("note", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    return o.select(
        F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("glyph"), F.coalesce("note", F.lit("none")).alias("note"), F.lit("{}").alias("meta")
    )


@query(
    "pr18_pair_class",
    """WITH k AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'd' WHEN 'view' THEN 'longs' WHEN 'click' THEN 'D' WHEN 'error' THEN 'w' ELSE 'n' END AS left_key FROM events)
SELECT event_id, left_key, CASE left_key WHEN 'd' THEN 'loop_exit' WHEN 'longs' THEN 'loop_exit' WHEN 'D' THEN 'capital' WHEN 'w' THEN 'deckstrich_arm' ELSE 'arcade_diagonal' END AS class FROM k""",
)
def _(spark, d):
    t = F.col("event_type")
    key = F.when(t == "signup", "d").when(t == "view", "longs").when(t == "click", "D").when(t == "error", "w").otherwise("n")
    e = V.table(spark, d, "events").select("event_id", key.alias("left_key"))
    return e.withColumn("class", C.pair_class(F.col("left_key")))


@query("sc01_table_scan", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(spark, d):
    from traceframe.sources.readers import scan_table

    n, g = scan_table(spark, f"{d}/nation.parquet", "nation"), scan_table(spark, f"{d}/region.parquet", "region")
    return n.join(g, n.n_regionkey == g.r_regionkey).select("n_nationkey", "n_name", "r_name")


@query(
    "sc01_typed_scans",
    V.with_views(
        V.TRACE,
        V.PIXELS,
        body="""SELECT 'trace' AS "table", count(*) AS rows, round(sum(x + y), 4) AS total FROM trace UNION ALL SELECT 'pixels', count(*), round(sum(x + y + grey), 4) FROM px
UNION ALL SELECT 'bboxes', count(*), round(sum(l_quantity + l_linenumber), 4) FROM lineitem UNION ALL SELECT 'work_items', count(*), round(sum(o_orderkey), 4) FROM orders
UNION ALL SELECT 'templates', count(*), round(sum(p_size + p_size + 1), 4) FROM part UNION ALL SELECT 'quiz_words', count(*), round(sum(length(text)), 4) FROM documents""",
    ),
)
def _(spark, d):
    """Typed tables written in their own schemas and scanned with them; sums run over what was read."""
    from traceframe.schemas import schema
    from traceframe.sources.readers import scan_table
    from traceframe.streaming.jobs import work_folder

    folder = work_folder(spark)
    li, p = V.table(spark, d, "lineitem"), F.col("p_size")
    point = F.struct(p.cast("double").alias("x"), (p + 1).cast("double").alias("y"))
    made = {
        "trace": V.traces(spark, d).withColumn("side", F.lit("A")),
        "pixels": V.pixels(spark, d),
        "bboxes": li.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("glyph_key"), F.col("l_quantity").alias("x0"), F.col("l_linenumber").alias("y0"), (F.col("l_returnflag") == "R").alias("locked")),
        "work_items": V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("closed_at")),
        "templates": V.table(spark, d, "part").select(F.col("p_brand").alias("style_id"), F.col("p_partkey").alias("variant"), F.array(point).alias("anchors"), point.alias("entry")),
        "quiz_words": V.table(spark, d, "documents").select(F.col("text").alias("word"), F.array("lang", "source").alias("distractors")),
    }
    sums = {
        "trace": F.col("x") + F.col("y"), "pixels": F.col("x") + F.col("y") + F.col("grey"), "bboxes": F.col("x0") + F.col("y0"), "work_items": F.col("id"),
        "templates": F.get("anchors", F.lit(0))["x"] + F.col("entry.y"), "quiz_words": F.length("word"),
    }
    out = None
    for name, df in made.items():
        typed = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)]
        df.select(*typed).write.parquet(f"{folder}/{name}")
        one = scan_table(spark, f"{folder}/{name}", name).agg(F.count(F.lit(1)).alias("rows"), r(F.sum(sums[name]).cast("double"), 4).alias("total"))
        one = one.select(F.lit(name).alias("table"), "rows", "total")
        out = one if out is None else out.unionByName(one)
    return out
