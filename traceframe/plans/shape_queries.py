"""Queries over occurrences and transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions.quantiles import exact_quantiles
from traceframe.functions.stats import r
from traceframe.operators import shape_stats as S
from traceframe.plans import views as V
from traceframe.plans.registry import query
from traceframe.session import checkpointed

MIN_N = 4


@query(
    "ag01_modal_shape",
    V.with_views(
        V.OCC,
        V.OCC_POINTS,
        body="""SELECT o.glyph_key, m.n_points AS modal_points, count(*) FILTER (o.n_points = m.n_points) AS kept,
  count(*) FILTER (o.n_points <> m.n_points) AS dropped
FROM occ o JOIN occ_modal m USING (glyph_key) GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    shaped = S.modal_shape(V.occurrences(spark, d), ["glyph_key"])
    return shaped.groupBy("glyph_key", "modal_points").agg(
        F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped")
    )


def _kept_points(spark, d):
    kept = S.modal_shape(V.occurrences(spark, d), ["glyph_key"]).where("kept")
    return S.points_long(kept, ["glyph_key", "seq"])


@query(
    "ag02_median_mad",
    V.with_views(
        V.OCC,
        V.OCC_POINTS,
        body="""SELECT p.glyph_key, CAST(p.i AS BIGINT) AS i, round(any_value(mx), 4) + 0.0 AS med_x, round(any_value(my), 4) + 0.0 AS med_y,
  round(median(abs(x - mx)), 4) + 0.0 AS mad_x, round(median(abs(y - my)), 4) + 0.0 AS mad_y, count(*) AS n
FROM occ_pt p JOIN occ_med USING (glyph_key, i) GROUP BY p.glyph_key, p.i HAVING count(*) >= 4""",
    ),
)
def _(spark, d):
    long = _kept_points(spark, d)
    n = long.groupBy("glyph_key", "i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_N)
    prof = S.element_median_mad(long, ["glyph_key"]).join(n, ["glyph_key", "i"])
    return prof.select(
        "glyph_key", "i", *[r(c, 4).alias(c) for c in ("med_x", "med_y", "mad_x", "mad_y")], "n"
    )


@query(
    "ag03_min_n_gate",
    V.with_views(
        V.OCC,
        V.OCC_POINTS,
        body="""SELECT glyph_key, CASE WHEN u >= 50 THEN u ELSE 0 END AS n_instances, s AS anchor_shape,
  CASE WHEN u >= 50 THEN 0 ELSE u END AS below_min_n
FROM (SELECT glyph_key, count(*) FILTER (o.n_points = m.n_points) AS u, count(*) FILTER (o.n_points <> m.n_points) AS s
  FROM occ o JOIN occ_modal m USING (glyph_key) GROUP BY 1)""",
    ),
)
def _(spark, d):
    return S.gated_groups(V.occurrences(spark, d), ["glyph_key"], 50)


@query(
    "ag04_pooled_stats",
    V.with_views(
        V.OCC,
        V.OCC_POINTS,
        body="""SELECT glyph_key, round(avg(geo_rmse_px), 6) AS geo_rmse_mean, round(max(geo_rmse_px), 6) AS geo_rmse_max,
  round(avg(xh_px), 6) AS xh_px_mean, count(DISTINCT specimen_id) AS n_specimens, count(*) AS n_instances
FROM occ_kept GROUP BY 1""",
    ),
)
def _(spark, d):
    kept = S.modal_shape(V.occurrences(spark, d), ["glyph_key"]).where("kept")
    s = S.pooled_stats(kept, ["glyph_key"])
    return s.select(
        "glyph_key",
        *[r(c).alias(c) for c in ("geo_rmse_mean", "geo_rmse_max", "xh_px_mean")],
        "n_specimens",
        "n_instances",
    )


@query(
    "ag04_position_histogram",
    V.with_views(
        V.OCC, V.OCC_POINTS, body='SELECT glyph_key, "position", count(*) AS n FROM occ_kept GROUP BY 1, 2'
    ),
)
def _(spark, d):
    kept = S.modal_shape(V.occurrences(spark, d), ["glyph_key"]).where("kept")
    return S.histogram(kept, ["glyph_key"], "position")


def _transitions(spark, d):
    return V.transitions(spark, d).withColumn("reason", S.transition_reason())


TR = V.PAIRS + """,
trr AS (SELECT *, CASE WHEN NOT coalesce(fit_ok, false) THEN 'fit_bad' WHEN NOT good_geometry THEN 'geometry' END AS reason FROM tr)"""


@query(
    "ag05_transition_counts",
    V.with_views(TR, body="SELECT coalesce(reason, 'used') AS reason, count(*) AS n FROM trr GROUP BY 1"),
)
def _(spark, d):
    return (
        _transitions(spark, d)
        .groupBy(F.coalesce("reason", F.lit("used")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


TR_POINTS = TR + """,
tp0 AS (SELECT left_key, right_key, dx, dy, dx / 2 AS hx, dy + 1 AS hy, sqrt((dx / 2) ** 2 + (dy + 1) ** 2) AS l1,
  sqrt((dx - dx / 2) ** 2 + 1) AS l2 FROM trr WHERE reason IS NULL),
tp AS (SELECT left_key, right_key, k AS i,
  CASE WHEN k = -1 OR k = 23 THEN dx WHEN (l1 + l2) * k / 23 <= l1 AND l1 > 0 THEN hx * ((l1 + l2) * k / 23 / l1)
    ELSE hx + ((l1 + l2) * k / 23 - l1) / l2 * (dx - hx) END AS x,
  CASE WHEN k = -1 OR k = 23 THEN dy WHEN (l1 + l2) * k / 23 <= l1 AND l1 > 0 THEN hy * ((l1 + l2) * k / 23 / l1)
    ELSE hy + ((l1 + l2) * k / 23 - l1) / l2 * (dy - hy) END AS y
  FROM tp0, (SELECT unnest(range(-1, 24)) AS k)),
tm AS (SELECT left_key, right_key, i, median(x) AS mx, median(y) AS my FROM tp GROUP BY 1, 2, 3)"""


@query(
    "ag05_transition_profile",
    V.with_views(
        TR_POINTS,
        body="""SELECT p.left_key, p.right_key, CAST(p.i AS BIGINT) AS i, round(any_value(mx), 4) + 0.0 AS med_x,
  round(any_value(my), 4) + 0.0 AS med_y, round(median(abs(x - mx)), 4) + 0.0 AS mad_x, round(median(abs(y - my)), 4) + 0.0 AS mad_y
FROM tp p JOIN tm USING (left_key, right_key, i) GROUP BY 1, 2, 3""",
    ),
)
def _(spark, d):
    rows = _transitions(spark, d).where("reason IS NULL")
    keys = ["left_key", "right_key"]
    # four passes read the points; computing them once is cheaper than four times
    prof = S.element_median_mad(checkpointed(S.transition_points(rows, keys)), keys)
    return prof.select(*keys, "i", *[r(c, 4).alias(c) for c in ("med_x", "med_y", "mad_x", "mad_y")])


_QC = ["gen_chamfer_mean", "gen_chamfer_max", "harvest_chamfer_mean", "harvest_chamfer_max", "resid_mean", "resid_max", "gap_ink_share"]


@query(
    "ag06_transition_quality",
    V.with_views(
        TR,
        body="""SELECT left_key, right_key, round(avg(gen_chamfer), 9) AS gen_chamfer_mean, round(max(gen_chamfer), 9) AS gen_chamfer_max,
  round(avg(harvest_chamfer), 9) AS harvest_chamfer_mean, round(max(harvest_chamfer), 9) AS harvest_chamfer_max,
  round(avg(CASE WHEN a_resid IS NOT NULL AND b_resid IS NOT NULL THEN greatest(a_resid, b_resid) END), 9) AS resid_mean,
  round(max(CASE WHEN a_resid IS NOT NULL AND b_resid IS NOT NULL THEN greatest(a_resid, b_resid) END), 9) AS resid_max,
  round(avg(CAST(CAST(gap_ink AS INTEGER) AS DOUBLE)), 9) AS gap_ink_share, count(*) FILTER (kind = 'pairs') AS n_pairs,
  count(*) FILTER (kind = 'words') AS n_words, count(DISTINCT kind || '/' || specimen_id) AS n_specimens, count(*) AS n_instances
FROM trr WHERE reason IS NULL GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    q = S.transition_quality(_transitions(spark, d).where("reason IS NULL"), ["left_key", "right_key"])
    return q.select("left_key", "right_key", *[r(c, 9).alias(c) for c in _QC], "n_pairs", "n_words", "n_specimens", "n_instances")


STORED = """
stored AS (SELECT glyph_key, i, x, y FROM (SELECT glyph_key, CAST(i AS BIGINT) AS i, CAST(e[2 * i + 1] AS DOUBLE) AS x,
  CAST(e[2 * i + 2] AS DOUBLE) AS y FROM (SELECT glyph_key, n_points, e FROM (SELECT *, row_number() OVER (PARTITION BY glyph_key ORDER BY seq) AS rn
  FROM occ) WHERE rn = 1), (SELECT unnest(range(0, 32)) AS i) WHERE i < n_points))"""


def _first_forms(spark, d):
    """The first occurrence of each key stands in for its stored form."""
    return S.best_row(V.occurrences(spark, d), ["glyph_key"], [F.col("seq")])


@query(
    "ag07_form_deviation",
    V.with_views(
        V.OCC,
        V.OCC_POINTS,
        STORED,
        body="""SELECT glyph_key, CASE WHEN count(*) FILTER (mx IS NULL OR s.x IS NULL) = 0 THEN round(avg(sqrt((mx - s.x) ** 2 + (my - s.y) ** 2)), 4) END AS deviation,
  count(mx) AS n_points
FROM occ_med FULL OUTER JOIN stored s USING (glyph_key, i) GROUP BY 1""",
    ),
)
def _(spark, d):
    center = S.element_median_mad(_kept_points(spark, d), ["glyph_key"])
    stored = S.points_long(_first_forms(spark, d), ["glyph_key"])
    dev = S.form_deviation(center, stored, ["glyph_key"])
    return dev.select("glyph_key", r("deviation", 4).alias("deviation"), "n_points")


def _nested_center(spark, d):
    """Median forms as nested arrays; a form has as many elements as one occurrence."""
    center = S.element_median_mad(_kept_points(spark, d), ["glyph_key"])
    nested = center.groupBy("glyph_key").agg(
        F.array_sort(F.collect_list(F.struct("i", F.col("med_x").alias("x"), F.col("med_y").alias("y")))).alias("c")
    )
    kept = S.modal_shape(V.occurrences(spark, d), ["glyph_key"]).where("kept")
    n = kept.groupBy("glyph_key").agg(F.count(F.lit(1)).alias("n_instances"))
    k = F.col("glyph_key").cast("int")
    variant = F.when(k % 7 == 5, S.DERIVED_VARIANT).when(k % 7 == 6, 1).otherwise(0)
    pts = F.transform("c", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return nested.join(n, "glyph_key").select("glyph_key", variant.alias("variant"), pts.alias("center"), "n_instances")


@query(
    "ag08_promotion",
    V.with_views(
        V.OCC,
        V.OCC_POINTS,
        STORED,
        """
agg AS (SELECT glyph_key, count(DISTINCT i) AS np FROM occ_pt GROUP BY 1),
cnt AS (SELECT glyph_key, count(*) AS n_instances, CASE WHEN CAST(glyph_key AS INTEGER) % 7 = 5 THEN 100 WHEN CAST(glyph_key AS INTEGER) % 7 = 6 THEN 1 ELSE 0 END AS variant FROM occ_kept GROUP BY 1),
ends AS (SELECT glyph_key, max(i) AS li FROM stored GROUP BY 1),
dev AS (SELECT glyph_key, avg(sqrt((mx - s.x) ** 2 + (my - s.y) ** 2)) AS deviation FROM occ_med JOIN stored s USING (glyph_key, i) GROUP BY 1),
tri AS (SELECT c.glyph_key, c.variant, c.n_instances, li, CASE WHEN c.glyph_key = '8' THEN 'excluded' WHEN variant = 100 THEN 'derived_variant'
  WHEN variant <> 0 THEN 'non_base_variant' WHEN c.glyph_key = '0' THEN 'no_base' WHEN np <> li + 1 THEN 'anchor_count'
  WHEN n_instances < 45 THEN 'below_min_occurrences' END AS reason FROM cnt c JOIN agg USING (glyph_key) JOIN ends USING (glyph_key))""",
        body="""SELECT t.glyph_key, t.variant, t.n_instances, t.reason,
  CASE WHEN reason IS NULL THEN round(s.x + (m.mx - s.x) + 1, 6) END AS advance,
  CASE WHEN reason IS NULL THEN t.glyph_key IN ('1', '2') END AS created,
  CASE WHEN reason IS NULL AND t.glyph_key NOT IN ('1', '2') THEN round(deviation, 4) END AS deviation
FROM tri t JOIN stored s ON s.glyph_key = t.glyph_key AND s.i = li LEFT JOIN occ_med m ON m.glyph_key = t.glyph_key AND m.i = li LEFT JOIN dev ON dev.glyph_key = t.glyph_key""",
    ),
)
def _(spark, d):
    first = _first_forms(spark, d)
    base = first.where(F.col("glyph_key") != "0").select(
        "glyph_key",
        "anchors",
        F.get("anchors", F.lit(0)).alias("entry"),
        F.element_at("anchors", -1).alias("exit"),
        (F.element_at("anchors", -1)["x"] + 1).alias("advance"),
    )
    stored = first.where(~F.col("glyph_key").isin("1", "2"))
    keys = [str(k) for k in range(1000) if k != 8]
    out = S.promote(_nested_center(spark, d), base, stored, keys, 45)
    return out.select(
        "glyph_key", "variant", "n_instances", "reason", r("advance").alias("advance"), "created", r("deviation", 4).alias("deviation")
    )


@query(
    "ag09_harvest_medians",
    V.with_views(
        V.OCC,
        V.OCC_POINTS,
        STORED,
        body="""SELECT glyph_key, n, rank() OVER (ORDER BY n DESC, glyph_key) AS "rank", round(shift, 4) AS shift FROM (
  SELECT glyph_key, any_value(n) AS n, CASE WHEN count(*) FILTER (mx IS NULL OR s.x IS NULL) = 0 THEN avg(sqrt((mx - s.x) ** 2 + (my - s.y) ** 2)) END AS shift
  FROM occ_med FULL OUTER JOIN stored s USING (glyph_key, i) JOIN (SELECT glyph_key, count(*) AS n FROM occ_kept GROUP BY 1) USING (glyph_key)
  WHERE n >= 40 GROUP BY 1)""",
    ),
)
def _(spark, d):
    from pyspark.sql.window import Window

    kept = S.modal_shape(V.occurrences(spark, d), ["glyph_key"]).where("kept")
    n = kept.groupBy("glyph_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 40)
    center = S.element_median_mad(_kept_points(spark, d), ["glyph_key"])
    dev = S.form_deviation(center, S.points_long(_first_forms(spark, d), ["glyph_key"]), ["glyph_key"])
    # one row per key: the key set is the registry of forms, not the data
    w = Window.orderBy(F.col("n").desc(), "glyph_key")
    return (
        dev.join(n, "glyph_key")
        .withColumn("rank", F.row_number().over(w).cast("bigint"))
        .select("glyph_key", "n", "rank", r("deviation", 4).alias("shift"))
    )


def _profiles(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.select(
        F.col("label").cast("string").alias("source"),
        F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("half_widths"),
    )


@query(
    "ag10_pooled_nib",
    """SELECT source, round(avg(m), 6) AS nib, count(*) AS n_profiles FROM (
  SELECT CAST(label AS VARCHAR) AS source, vec_id, median(abs(CAST(v AS DOUBLE))) AS m
  FROM (SELECT label, vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, d):
    return S.pooled_nib(_profiles(spark, d), ["source"], "half_widths").select(
        "source", r("nib").alias("nib"), "n_profiles"
    )


@query(
    "ag11_pen_percentiles",
    """WITH w AS (SELECT CAST(label AS VARCHAR) AS source, abs(CAST(v AS DOUBLE)) AS v FROM (SELECT label, unnest(embedding) AS v FROM embeddings)),
o AS (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM w),
p AS (SELECT source, any_value(n) AS n, max(CASE WHEN k = floor(0.10::DOUBLE * (n - 1) + 0.5) THEN v END) AS p10, max(CASE WHEN k = floor(0.95::DOUBLE * (n - 1) + 0.5) THEN v END) AS p95 FROM o GROUP BY 1)
SELECT source, n AS n_values, round(p10, 6) AS hairline_half, round(greatest(2 * p95, 0.001), 6) AS nib_width,
  round(least(greatest(2 * p10 / greatest(2 * p95, 0.001), 0.05), 0.5), 6) AS edge_fraction FROM p""",
)
def _(spark, d):
    return S.pen_calibration(_profiles(spark, d), ["source"], "half_widths").select(
        "source", "n_values", *[r(c).alias(c) for c in ("hairline_half", "nib_width", "edge_fraction")]
    )


@query(
    "ag12_modal_owner",
    V.with_views(
        V.OCC,
        body="""SELECT glyph_key, owner, n AS n_modal, several FROM (SELECT glyph_key, owner, count(*) AS n,
  row_number() OVER (PARTITION BY glyph_key ORDER BY count(*) DESC, min(seq)) AS rn, count(*) OVER (PARTITION BY glyph_key) > 1 AS several
  FROM occ WHERE owner IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""",
    ),
)
def _(spark, d):
    return S.modal_value(V.occurrences(spark, d), ["glyph_key"], "owner", "seq")


@query(
    "ag26_noise_floor",
    V.with_views(
        V.OCC,
        V.OCC_POINTS,
        """
mads AS (SELECT p.glyph_key, p.i, median(abs(x - mx)) AS m FROM occ_pt p JOIN occ_med USING (glyph_key, i) GROUP BY 1, 2),
own AS (SELECT glyph_key, avg(m) AS mad_mean, count(*) AS n FROM mads WHERE glyph_key <> '3' GROUP BY 1),
pool AS (SELECT median(m) AS pooled FROM mads WHERE glyph_key <> '3')""",
        body="""SELECT o.seq AS row_id, o.glyph_key AS key, CAST(o.n_points AS INTEGER) AS n_points, CASE WHEN own.n = o.n_points THEN 'aggregate' ELSE 'pooled' END AS source,
  round(CASE WHEN own.n = o.n_points THEN own.mad_mean ELSE pooled END, 6) AS mad_mean
FROM occ o LEFT JOIN own USING (glyph_key), pool""",
    ),
)
def _(spark, d):
    mads = S.element_median_mad(_kept_points(spark, d), ["glyph_key"]).where(F.col("glyph_key") != "3")
    own = mads.groupBy(F.col("glyph_key").alias("key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "mad_x"))), lambda s: s["mad_x"]).alias("mad")
    )
    pooled = exact_quantiles(mads, [], "mad_x", {"pooled": 0.5})
    rows = V.occurrences(spark, d).select(
        F.col("seq").alias("row_id"), F.col("glyph_key").alias("key"), F.size("anchors").alias("n_points")
    )
    return S.noise_floor(rows, own, pooled).withColumn("mad_mean", r("mad_mean"))
