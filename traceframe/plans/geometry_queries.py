"""Queries over traces, boxes and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions.stats import r
from traceframe.functions.udtf import register_resample
from traceframe.operators import geometry as G
from traceframe.operators import resample as Rs
from traceframe.operators import runs as R
from traceframe.operators import straight as T
from traceframe.plans import views as V
from traceframe.plans.registry import query

STROKE = G.STROKE
HYP = "sqrt(({a}) ** 2 + ({b}) ** 2)"

STEPS = V.TRACE + """,
w0 AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM trace WINDOW w AS (PARTITION BY case_id, stroke ORDER BY pos)),
st AS (SELECT *, sqrt((x - px) ** 2 + (y - py) ** 2) AS sp, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS sn FROM w0),
md AS (SELECT case_id, stroke, median(sp) AS med, count(*) AS n, max(sp) AS top FROM st GROUP BY 1, 2),
fl AS (SELECT st.*, coalesce(n >= 5 AND med > 0 AND sp / med >= 3 AND sn / med >= 3, false) AS flagged, CASE WHEN n >= 5 AND med > 0 THEN sp / med END AS rp, CASE WHEN n >= 5 AND med > 0 THEN sn / med END AS rn
  FROM st JOIN md USING (case_id, stroke))"""


@query(
    "wn06_arc_length",
    V.with_views(
        STEPS,
        body="SELECT case_id, stroke, CAST(pos AS BIGINT) AS pos, round(sum(coalesce(sp, 0)) OVER (PARTITION BY case_id, stroke ORDER BY pos), 6) AS arc FROM st",
    ),
)
def _(spark, d):
    a = Rs.with_arc(V.traces(spark, d), STROKE)
    return a.select(*STROKE, F.col("pos").cast("bigint").alias("pos"), r("arc").alias("arc"))


@query(
    "wn06_pen_lifts",
    V.with_views(
        V.TRACE,
        body="""SELECT case_id, stroke, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY case_id, stroke ORDER BY pos DESC) AS rn, max(stroke) OVER (PARTITION BY case_id) AS ms FROM trace) WHERE rn = 1 AND stroke < ms""",
    ),
)
def _(spark, d):
    return G.lift_points(V.traces(spark, d)).select(*STROKE, r("x").alias("x"), r("y").alias("y"))


@query(
    "wn07_step_outliers",
    V.with_views(STEPS, body="SELECT case_id, stroke, CAST(pos AS BIGINT) AS pos, round(rp, 6) AS ratio_prev, round(rn, 6) AS ratio_next FROM fl WHERE flagged"),
)
def _(spark, d):
    o = G.step_outliers(V.traces(spark, d)).where("flagged")
    return o.select(*STROKE, F.col("pos").cast("bigint").alias("pos"), r("ratio_prev").alias("ratio_prev"), r("ratio_next").alias("ratio_next"))


@query(
    "wn08_spike_ratio",
    V.with_views(STEPS, body="SELECT case_id, round(coalesce(max(CASE WHEN med > 0 THEN top / med WHEN top > 0 THEN 'inf'::DOUBLE END), 0), 6) AS spike_ratio FROM md GROUP BY 1"),
)
def _(spark, d):
    return G.spike_ratio(V.traces(spark, d), ["case_id"], STROKE).withColumn("spike_ratio", r("spike_ratio"))


REPAIR = STEPS + """,
k AS (SELECT *, last_value(CASE WHEN NOT flagged THEN pos END IGNORE NULLS) OVER (PARTITION BY case_id, stroke ORDER BY pos) AS lo, first_value(CASE WHEN NOT flagged THEN pos END IGNORE NULLS) OVER (PARTITION BY case_id, stroke ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM fl),
rp AS (SELECT k.case_id, k.stroke, k.pos, k.flagged AND l.pos IS NOT NULL AND h.pos IS NOT NULL AS repaired, CASE WHEN k.flagged AND l.pos IS NOT NULL AND h.pos IS NOT NULL THEN l.x + (k.pos - k.lo) / (k.hi - k.lo) * (h.x - l.x) ELSE k.x END AS x,
  CASE WHEN k.flagged AND l.pos IS NOT NULL AND h.pos IS NOT NULL THEN l.y + (k.pos - k.lo) / (k.hi - k.lo) * (h.y - l.y) ELSE k.y END AS y
  FROM k LEFT JOIN trace l ON l.case_id = k.case_id AND l.stroke = k.stroke AND l.pos = k.lo LEFT JOIN trace h ON h.case_id = k.case_id AND h.stroke = k.stroke AND h.pos = k.hi)"""


@query(
    "wn09_repair",
    V.with_views(REPAIR, body="SELECT case_id, stroke, CAST(pos AS BIGINT) AS pos, round(x, 6) AS x, round(y, 6) AS y, repaired FROM rp"),
)
def _(spark, d):
    p = G.repaired(V.traces(spark, d))
    return p.select(*STROKE, F.col("pos").cast("bigint").alias("pos"), r("x").alias("x"), r("y").alias("y"), "repaired")


@query(
    "wn10_islands",
    V.with_views(
        V.TRACE,
        """f AS (SELECT *, pos - row_number() OVER (PARTITION BY case_id, stroke ORDER BY pos) AS g FROM trace WHERE y > 0.5)""",
        body='SELECT case_id, stroke, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM f GROUP BY 1, 2, g HAVING count(*) >= 2',
    ),
)
def _(spark, d):
    t = V.traces(spark, d).withColumn("hot", F.col("y") > 0.5)
    return G.islands(t, STROKE, "pos", "hot", 2).withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")})


@query(
    "wn10_merged_islands",
    V.with_views(
        V.TRACE,
        """f AS (SELECT *, pos - lag(pos) OVER (PARTITION BY case_id, stroke ORDER BY pos) - 1 AS gap FROM trace WHERE y > 1.2),
g AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, stroke ORDER BY pos) AS isl FROM f)""",
        body='SELECT case_id, stroke, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM g GROUP BY 1, 2, isl',
    ),
)
def _(spark, d):
    t = V.traces(spark, d).withColumn("hot", F.col("y") > 1.2)
    return G.islands(t, STROKE, "pos", "hot", 1, 3).withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")})


@query(
    "wn10_vertical_runs",
    V.with_views(
        STEPS,
        """a0 AS (SELECT *, count(*) OVER (PARTITION BY case_id, stroke) AS np, sum(coalesce(sp, 0)) OVER (PARTITION BY case_id, stroke ORDER BY pos) AS arc, coalesce(nx, x) - coalesce(px, x) AS dx, coalesce(ny, y) - coalesce(py, y) AS dy FROM st),
vf AS (SELECT *, pos - row_number() OVER (PARTITION BY case_id, stroke ORDER BY pos) AS g FROM a0 WHERE np >= 4 AND degrees(atan2(abs(dx), abs(dy))) <= 40),
vr AS (SELECT case_id, stroke, g, min(pos) AS a, max(pos) AS b, max(arc) - min(arc) AS arc, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_max(x, pos) AS x1, arg_max(y, pos) AS y1 FROM vf GROUP BY 1, 2, 3),
vb AS (SELECT vr.case_id, vr.stroke, a, b, vr.arc, max(CASE WHEN sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) < 1e-6 THEN 'inf'::DOUBLE ELSE abs((x1 - x0) * (vf.y - y0) - (y1 - y0) * (vf.x - x0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2) END) AS bow
  FROM vr JOIN vf USING (case_id, stroke, g) WHERE vr.arc >= 0.45 AND b > a GROUP BY 1, 2, 3, 4, 5)""",
        body='SELECT case_id, stroke, a AS start, b AS "end", round(arc, 6) AS arc, round(bow, 6) AS bow FROM vb WHERE bow <= 0.15',
    ),
)
def _(spark, d):
    """The sample traces are jagged, so angle and bow are wider here than by default."""
    v = T.vertical_runs(V.traces(spark, d), angle=40.0, bow=0.15)
    return v.select(*STROKE, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), r("arc").alias("arc"), r("bow").alias("bow"))


@query(
    "wn10_merged_events",
    V.with_views(
        V.TRACE,
        """f AS (SELECT *, pos - lag(pos) OVER (PARTITION BY case_id, stroke ORDER BY pos) AS gap FROM trace WHERE y > 1.2),
g AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, stroke ORDER BY pos) AS isl FROM f)""",
        body='SELECT case_id, stroke, min(pos) AS start, max(pos) AS "end", count(*) AS n, round((max(pos) - min(pos)) * 0.1::DOUBLE, 6) AS arc FROM g GROUP BY 1, 2, isl HAVING (max(pos) - min(pos)) * 0.1::DOUBLE >= 0.25::DOUBLE',
    ),
)
def _(spark, d):
    t = V.traces(spark, d).withColumn("hot", F.col("y") > 1.2)
    e = T.merged_events(t, STROKE, "pos", "hot", 0.1)
    return e.select(*STROKE, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "n", r("arc").alias("arc"))


@query(
    "wn10_row_bands",
    """WITH p AS (SELECT l_suppkey AS page, l_orderkey % 400 AS y, count(*) AS k FROM lineitem WHERE l_orderkey % 400 % 97 < 60 GROUP BY 1, 2),
gg AS (SELECT a.page, a.yy AS y, coalesce(p.k, 0) AS n FROM (SELECT page, unnest(range(400)) AS yy FROM (SELECT DISTINCT page FROM p)) a LEFT JOIN p ON p.page = a.page AND p.y = a.yy),
s AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9 AS smooth FROM gg),
t AS (SELECT page, quantile_cont(smooth, 0.99::DOUBLE) AS top FROM s WHERE smooth > 0 GROUP BY 1),
f AS (SELECT s.*, y - lag(y) OVER (PARTITION BY page ORDER BY y) - 1 AS gap FROM s JOIN t USING (page) WHERE smooth >= 0.30::DOUBLE * top),
i AS (SELECT *, sum(CASE WHEN gap >= 14 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y) AS isl FROM f),
b AS (SELECT page, min(y) AS y0, max(y) + 1 AS y1 FROM i GROUP BY page, isl HAVING max(y) + 1 - min(y) >= 22)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY y0) - 1 AS band, y0, y1 FROM b""",
)
def _(spark, d):
    """Orders as pixels of a page for each supplier, with bare stripes between the lines."""
    li = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") % 400).alias("y")).where("y % 97 < 60")
    every = li.select("page").distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(399).cast("bigint"))))
    rows = every.join(li.groupBy("page", "y").agg(F.count(F.lit(1)).alias("n")), ["page", "y"], "left").fillna(0, ["n"])
    b = T.row_bands(rows, ["page"])
    return b.select("page", *[F.col(c).cast("bigint").alias(c) for c in ("band", "y0", "y1")])


@query(
    "wn11_gap_clusters",
    """WITH b AS (SELECT l_suppkey AS line, l_orderkey * 10 + l_linenumber AS k, min(l_extendedprice / 100) AS x0, min(l_extendedprice / 100 + l_quantity / 10) AS x1 FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, max(x1) OVER (PARTITION BY line ORDER BY x0, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM b),
c AS (SELECT *, sum(CASE WHEN x0 - e >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY x0, k) AS cluster FROM m)
SELECT line, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(min(x0), 6) AS x0, round(max(x1), 6) AS x1 FROM c GROUP BY 1, 2""",
)
def _(spark, d):
    li = V.table(spark, d, "lineitem")
    x0 = F.col("l_extendedprice") / 100
    b = li.groupBy(F.col("l_suppkey").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).agg(
        F.min(x0).alias("x0"), F.min(x0 + F.col("l_quantity") / 10).alias("x1")
    )
    c = G.gap_clusters(b, ["line"], 5.0, "k")
    return c.groupBy("line", F.col("cluster").cast("bigint").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), r(F.min("x0")).alias("x0"), r(F.max("x1")).alias("x1")
    )


@query(
    "wn13_decimated_peaks",
    V.with_views(
        V.TRACE,
        """c AS (SELECT case_id, stroke * 100000 + pos AS p, y, row_number() OVER (PARTITION BY case_id ORDER BY stroke, pos) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n FROM trace),
b AS (SELECT *, i // CASE WHEN n <= 20 THEN 1 ELSE CAST(ceil(n / 20) AS BIGINT) END AS w FROM c)""",
        body="SELECT case_id, i, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY case_id, w ORDER BY y DESC, i) AS rn FROM b) WHERE rn = 1",
    ),
)
def _(spark, d):
    from traceframe.functions.ordered import dense_position

    t = dense_position(V.traces(spark, d), ["case_id"], ["pos"], F.col("stroke"), "i")
    return G.decimated(t, ["case_id"], "i", "y", 20).select("case_id", "i", r("y").alias("y"))


@query(
    "wn14_tangents",
    V.with_views(
        STEPS,
        """t AS (SELECT case_id, stroke, pos, (coalesce(nx, x) - coalesce(px, x)) / CASE WHEN px IS NULL OR nx IS NULL THEN 1 ELSE 2 END AS dx, (coalesce(ny, y) - coalesce(py, y)) / CASE WHEN px IS NULL OR nx IS NULL THEN 1 ELSE 2 END AS dy FROM w0)""",
        body="SELECT case_id, stroke, CAST(pos AS BIGINT) AS pos, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dx / sqrt(dx ** 2 + dy ** 2) END, 6) + 0.0 AS tx, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dy / sqrt(dx ** 2 + dy ** 2) END, 6) + 0.0 AS ty FROM t",
    ),
)
def _(spark, d):
    t = G.tangents(V.traces(spark, d))
    return t.select(*STROKE, F.col("pos").cast("bigint").alias("pos"), r("tx").alias("tx"), r("ty").alias("ty"))


@query(
    "wn14_curvature",
    V.with_views(
        STEPS,
        """k AS (SELECT case_id, stroke, pos, CASE WHEN sp IS NULL OR sn IS NULL THEN 0 ELSE acos(greatest(-1, least(1, ((x - px) * (nx - x) + (y - py) * (ny - y)) / (CASE WHEN sp = 0 THEN 1 ELSE sp END * CASE WHEN sn = 0 THEN 1 ELSE sn END))))
  / CASE WHEN sp + sn = 0 THEN 1 ELSE 0.5 * (sp + sn) END END AS kappa FROM st),
v AS (SELECT *, lag(kappa) OVER (PARTITION BY case_id, stroke ORDER BY pos) AS pk, lead(kappa) OVER (PARTITION BY case_id, stroke ORDER BY pos) AS nk FROM k)""",
        body="SELECT case_id, round(max(kappa), 4) AS max_kappa, round(coalesce(avg(abs(kappa - pk)), 0), 4) AS variation, round(coalesce(avg(abs(nk - 2 * kappa + pk)), 0), 4) AS jerk FROM v GROUP BY 1",
    ),
)
def _(spark, d):
    k = G.curvature(V.traces(spark, d))
    top = k.groupBy("case_id").agg(F.max("kappa").alias("max_kappa"))
    j = top.join(G.variation_per_step(k, ["case_id"], STROKE, "kappa"), "case_id").join(
        G.second_difference(k, ["case_id"], STROKE, "kappa"), "case_id"
    )
    return j.select("case_id", *[r(c, 4).alias(c) for c in ("max_kappa", "variation", "jerk")])


def _row_density(spark, d):
    """Ink count of every row of a mask, empty rows included."""
    px = V.inks(spark, d)
    rows = px.select("mask_id").distinct().select("mask_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("y"))
    n = px.groupBy("mask_id", "y").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, ["mask_id", "y"], "left").select("mask_id", "y", F.coalesce("n", F.lit(0)).alias("n"))


DENS = V.PIXELS + """,
dn AS (SELECT m.mask_id, m.y, coalesce(n, 0) AS n FROM (SELECT mask_id, y FROM (SELECT DISTINCT mask_id FROM ik), (SELECT unnest(range(64))::INTEGER AS y)) m
  LEFT JOIN (SELECT mask_id, y, count(*) AS n FROM ik GROUP BY 1, 2) USING (mask_id, y))"""


@query(
    "wn15_moving_mean",
    V.with_views(DENS, body="SELECT mask_id, y, round(sum(n) OVER (PARTITION BY mask_id ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9, 6) AS smooth FROM dn"),
)
def _(spark, d):
    s = G.box_smoothed(_row_density(spark, d), ["mask_id"], "y", "n", 9, "smooth")
    return s.select("mask_id", "y", r("smooth").alias("smooth"))


from traceframe.sources.readers import gaussian_kernel  # noqa: E402

K2 = gaussian_kernel(2.0)


@query(
    "wn15_gauss_smoothing",
    V.with_views(
        DENS,
        "kk AS (SELECT unnest(range(-8, 9)) AS o, unnest([" + ", ".join(f"{w!r}::DOUBLE" for w in K2) + "]) AS w)",
        body="SELECT a.mask_id, a.y, round(sum(w * b.n), 6) AS smooth FROM dn a, kk JOIN dn b ON b.mask_id = a.mask_id AND b.y = greatest(0, least(63, a.y + o)) GROUP BY 1, 2",
    ),
)
def _(spark, d):
    s = G.gauss_smoothed(_row_density(spark, d), ["mask_id"], "y", "n", 2.0, "smooth")
    return s.select("mask_id", "y", r("smooth").alias("smooth"))


@query(
    "wn19_first_lasting_drop",
    V.with_views(
        STEPS,
        """pf AS (SELECT case_id, stroke, pos, sum(coalesce(sp, 0)) OVER (PARTITION BY case_id, stroke ORDER BY pos) AS arc, y AS dev FROM st)""",
        body="""SELECT p.case_id, p.stroke, round(coalesce(min(p.arc) FILTER (p.dev <= 1 AND NOT EXISTS (SELECT 1 FROM pf q WHERE q.case_id = p.case_id AND q.stroke = p.stroke AND q.pos >= p.pos AND q.arc < p.arc + 8 AND q.dev > 1)), max(p.arc)), 6) AS adapted_at FROM pf p GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    prof = Rs.with_arc(V.traces(spark, d), STROKE).withColumn("dev", F.col("y"))
    return G.first_lasting_drop(prof, STROKE, 1.0, 8.0).withColumn("adapted_at", r("adapted_at"))


SEGS = STEPS + """,
ar AS (SELECT case_id, stroke, pos, x, y, sum(coalesce(sp, 0)) OVER (PARTITION BY case_id, stroke ORDER BY pos) AS arc FROM st),
tt AS (SELECT case_id, stroke, max(arc) AS total, count(*) AS np, max_by(x, pos) AS ex, max_by(y, pos) AS ey, min_by(x, pos) AS bx, min_by(y, pos) AS byy FROM ar GROUP BY 1, 2),
sg AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(arc) OVER w AS hi FROM ar WINDOW w AS (PARTITION BY case_id, stroke ORDER BY pos))"""


def _resample_sql(n: str) -> str:
    return SEGS + f""",
tn AS (SELECT *, {n} AS n FROM tt),
ti AS (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS i FROM tn),
rs AS (SELECT t.case_id, t.stroke, t.i, CASE WHEN t.i = n - 1 THEN ex WHEN total <= 0 THEN bx ELSE s.x + (total * t.i / (n - 1) - s.arc) / (s.hi - s.arc) * (s.x1 - s.x) END AS x,
  CASE WHEN t.i = n - 1 THEN ey WHEN total <= 0 THEN byy ELSE s.y + (total * t.i / (n - 1) - s.arc) / (s.hi - s.arc) * (s.y1 - s.y) END AS y
  FROM ti t LEFT JOIN sg s ON s.case_id = t.case_id AND s.stroke = t.stroke AND s.hi > s.arc AND total * t.i / (n - 1) >= s.arc AND total * t.i / (n - 1) < s.hi)"""


@query(
    "sm01_resample_by_step",
    V.with_views(
        _resample_sql("CASE WHEN total > 0 THEN greatest(2, round_even(total / 0.5::DOUBLE, 0) + 1) ELSE 2 END"),
        body="SELECT case_id, stroke, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(max(x), 6) AS max_x FROM rs GROUP BY 1, 2",
    ),
)
def _(spark, d):
    s = Rs.resample_by_step(V.traces(spark, d), STROKE, 0.5)
    return s.groupBy(*STROKE).agg(F.count(F.lit(1)).alias("n"), r(F.avg("x")).alias("mean_x"), r(F.avg("y")).alias("mean_y"), r(F.max("x")).alias("max_x"))


@query(
    "ud03_resample_table_function",
    V.with_views(
        _resample_sql("CASE WHEN total > 0 THEN greatest(2, round_even(total / 0.5::DOUBLE, 0) + 1) ELSE 2 END"),
        body="SELECT case_id, stroke, CAST(i AS BIGINT) AS i, round(x, 6) AS x, round(y, 6) AS y FROM rs",
    ),
)
def _(spark, d):
    register_resample(spark, "traceframe_resample")
    t = V.traces(spark, d)
    s = spark.sql("SELECT * FROM traceframe_resample(TABLE(SELECT * FROM {t}) PARTITION BY (case_id, stroke) ORDER BY (pos), 0.5D)", t=t)
    return s.select(*STROKE, "i", r("x").alias("x"), r("y").alias("y"))


@query(
    "sm02_resample_to_n",
    V.with_views(_resample_sql("24"), body="SELECT case_id, stroke, CAST(i AS BIGINT) AS i, round(x, 6) AS x, round(y, 6) AS y FROM rs"),
)
def _(spark, d):
    return Rs.resample_to(V.traces(spark, d), STROKE, 24).select(*STROKE, "i", r("x").alias("x"), r("y").alias("y"))


@query(
    "sm03_frame_transform",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount AS y, CASE WHEN l_tax > 0.02::DOUBLE THEN l_tax * 500 END AS xh, CASE WHEN l_linenumber > 2 THEN l_linenumber * 1.0::DOUBLE END AS tx, CASE WHEN l_linenumber <> 4 THEN 80.0::DOUBLE END AS base FROM lineitem)
SELECT l_orderkey, l_linenumber, round((x * coalesce(nullif(xh, 0), 30) + coalesce(tx, 0)) / 30, 6) AS x, round((75 - (coalesce(base, 75) - y * coalesce(nullif(xh, 0), 30))) / 30, 6) + 0.0 AS y FROM p""",
)
def _(spark, d):
    n = F.col("l_linenumber")
    p = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    b = G.to_bench(
        p, F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 500), F.when(n > 2, n * 1.0), F.lit(None).cast("double"), F.when(n != 4, F.lit(80.0)), F.lit(30.0), F.lit(75.0)
    )
    return b.select("l_orderkey", "l_linenumber", r("x").alias("x"), r("y").alias("y"))


@query(
    "sm04_variant_roundtrip",
    """WITH c AS (SELECT p_partkey, p_size + 10 AS w, p_size % 7 + 20 AS h FROM part), g AS (SELECT unnest([-4.0, 0.0, 4.0]::DOUBLE[]) AS degrees, s FROM (SELECT unnest([1.0, 0.8]::DOUBLE[]) AS s))
SELECT p_partkey, degrees, s AS scale, CAST(greatest(1, ceil(w * abs(cos(radians(degrees))) + h * abs(sin(radians(degrees))) - 1e-9)) AS BIGINT) AS box_w, round(w / 3.0::DOUBLE, 6) AS x, round(h / 4.0::DOUBLE, 6) AS y FROM c, g""",
)
def _(spark, d):
    cases = V.table(spark, d, "part").select("p_partkey", (F.col("p_size") + 10).alias("w"), (F.col("p_size") % 7 + 20).alias("h"))
    v = G.variants(cases, [-4.0, 0.0, 4.0], [1.0, 0.8])
    u, w = G.to_variant(F.col("w") / 3, F.col("h") / 4)
    x, y = G.from_variant(F.col("u"), F.col("v"))
    return v.withColumn("u", u).withColumn("v", w).select("p_partkey", "degrees", "scale", F.col("box_w").cast("bigint").alias("box_w"), r(x).alias("x"), r(y).alias("y"))


@query(
    "sm05_body_and_marks",
    V.with_views(
        STEPS,
        """c AS (SELECT case_id, stroke, count(*) AS n, min(y) AS min_y, coalesce(sum(sp), 0) AS arc FROM st GROUP BY 1, 2)""",
        body="SELECT case_id, stroke, n, round(min_y, 6) AS min_y, round(arc, 6) AS arc, stroke > min(stroke) OVER (PARTITION BY case_id) AND min_y > 1.0 AND arc <= 0.8 AS is_mark FROM c",
    ),
)
def _(spark, d):
    c = G.stroke_classes(V.traces(spark, d))
    return c.select(*STROKE, "n", r("min_y").alias("min_y"), r("arc").alias("arc"), "is_mark")


BAND = STEPS + """,
sx AS (SELECT case_id, stroke, pos, x AS x0, y AS y0, nx AS x1, ny AS y1, (2.5 - x) / nullif(nx - x, 0) AS ta, (7.5 - x) / nullif(nx - x, 0) AS tb FROM w0 WHERE nx IS NOT NULL),
cl AS (SELECT *, CASE WHEN x1 = x0 THEN 0 ELSE greatest(0, least(ta, tb)) END AS t0, CASE WHEN x1 = x0 THEN 1 ELSE least(1, greatest(ta, tb)) END AS t1 FROM sx),
cb AS (SELECT * FROM cl WHERE x1 = x0 AND x0 BETWEEN 2.5 AND 7.5 OR x1 <> x0 AND t1 > t0)"""


@query(
    "sm06_clipped_band",
    V.with_views(BAND, body="SELECT case_id, count(*) AS n, round(sum((t1 - t0) * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)), 6) AS arc FROM cb GROUP BY 1"),
)
def _(spark, d):
    c = G.clipped_to_band(G.segments(V.traces(spark, d)), F.lit(2.5), F.lit(7.5))
    length = (F.col("t1") - F.col("t0")) * F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return c.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum(length)).alias("arc"))


@query(
    "sm06_common_window",
    V.with_views(
        V.TRACE,
        "g AS (SELECT case_id, stroke, min(x) AS lo, max(x) AS hi FROM trace GROUP BY 1, 2), h AS (SELECT case_id, max(lo) AS lo, min(hi) AS hi FROM g GROUP BY 1)",
        body="SELECT case_id, round(CASE WHEN hi > lo THEN lo END, 6) AS x_lo, round(CASE WHEN hi > lo THEN hi END, 6) AS x_hi FROM h",
    ),
)
def _(spark, d):
    w = G.common_window(V.traces(spark, d).select("case_id", F.col("stroke").alias("curve"), "x"), ["case_id"])
    return w.select("case_id", r("x_lo").alias("x_lo"), r("x_hi").alias("x_hi"))


@query(
    "sm06_trimmed_curve",
    V.with_views(
        V.TRACE,
        """cu AS (SELECT case_id * 100 + stroke - 1 AS case_id, pos, x, y FROM trace WHERE stroke > 0), re AS (SELECT case_id * 100 + stroke AS case_id, min_by(x, pos) AS px, min_by(y, pos) AS py, max_by(x, pos) AS qx, max_by(y, pos) AS qy FROM trace GROUP BY 1),
di AS (SELECT cu.case_id, pos, sqrt((x - px) ** 2 + (y - py) ** 2) AS dp, sqrt((x - qx) ** 2 + (y - qy) ** 2) AS dq FROM cu JOIN re USING (case_id)),
ab AS (SELECT case_id, arg_min(pos, dp) AS a, arg_min(pos, dq) AS b FROM di GROUP BY 1),
lh AS (SELECT case_id, CASE WHEN a = b THEN a - 1 ELSE least(a, b) END AS lo, CASE WHEN a = b THEN a + 1 ELSE greatest(a, b) END AS hi FROM ab)""",
        body="SELECT case_id, count(*) AS n, min(pos) AS first_pos FROM cu JOIN lh USING (case_id) WHERE pos BETWEEN lo AND hi GROUP BY 1",
    ),
)
def _(spark, d):
    first, second = V.week_pairs(V.traces(spark, d))
    c = G.trimmed_to_reference(second, first, ["case_id"])
    return c.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("bigint").alias("first_pos"))


@query(
    "sm07_shape_distance",
    V.with_views(
        _resample_sql("24"),
        """o AS (SELECT r.case_id, r.stroke, r.i, r.x - f.x AS x, r.y - f.y AS y FROM rs r JOIN rs f ON f.case_id = r.case_id AND f.stroke = r.stroke AND f.i = 0)""",
        body="SELECT a.case_id * 100 + a.stroke AS case_id, round(avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS dconn FROM o a JOIN o b ON b.case_id = a.case_id AND b.i = a.i AND b.stroke = a.stroke + 1 GROUP BY 1",
    ),
)
def _(spark, d):
    s = G.shape_distance(*V.week_pairs(V.traces(spark, d)), ["case_id"])
    return s.withColumn("dconn", r("dconn"))


@query(
    "sm08_arc_share",
    V.with_views(
        STEPS,
        """s AS (SELECT case_id, sn AS len, least(x, nx) AS lo, greatest(x, nx) AS hi FROM st WHERE nx IS NOT NULL)""",
        body="""SELECT case_id, round(sum(len * CASE WHEN hi > lo THEN least(1, greatest(0, (5 - lo) / (hi - lo))) WHEN lo < 5 THEN 1 ELSE 0 END), 6) AS left_arc, round(sum(len), 6) AS arc FROM s GROUP BY 1""",
    ),
)
def _(spark, d):
    s = G.segments(V.traces(spark, d))
    lo, hi = F.least("x0", "x1"), F.greatest("x0", "x1")
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    share = F.when(hi > lo, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (5 - lo) / (hi - lo)))).when(lo < 5, 1.0).otherwise(0.0)
    return s.groupBy("case_id").agg(r(F.sum(length * share)).alias("left_arc"), r(F.sum(length)).alias("arc"))


@query(
    "sm08_shape_delta",
    V.with_views(
        _resample_sql("64"),
        """dd AS (SELECT a.case_id * 100 + a.stroke AS case_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM rs a JOIN rs b ON b.case_id = a.case_id AND b.i = a.i AND b.stroke = a.stroke + 1),
m AS (SELECT case_id, median(d) AS m FROM dd GROUP BY 1)""",
        body="SELECT case_id, round(avg(abs(d - m)), 6) AS mean, round(quantile_cont(abs(d - m), 0.9::DOUBLE), 6) AS p90 FROM dd JOIN m USING (case_id) GROUP BY 1",
    ),
)
def _(spark, d):
    first, second = V.week_pairs(V.traces(spark, d))
    a = Rs.resample_to(first, ["case_id"], 64)
    b = Rs.resample_to(second, ["case_id"], 64).select("case_id", "i", F.col("x").alias("x2"), F.col("y").alias("y2"))
    s = G.shape_delta(a.join(b, ["case_id", "i"]), ["case_id"], F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))
    return s.select("case_id", r("mean").alias("mean"), r("p90").alias("p90"))


@query(
    "sm08_join_displacement",
    V.with_views(
        STEPS,
        """ar AS (SELECT case_id, stroke, pos, x, y, sum(coalesce(sp, 0)) OVER (PARTITION BY case_id, stroke ORDER BY pos) AS arc FROM st),
dl AS (SELECT *, abs(x - y) AS d, max(arc) OVER (PARTITION BY case_id, stroke) AS total, stroke = max(stroke) OVER (PARTITION BY case_id) AS joined FROM ar),
m AS (SELECT case_id, median(d) AS m FROM dl GROUP BY 1),
nr AS (SELECT case_id, abs(d - m) AS dev, joined AND CASE WHEN case_id % 2 = 0 THEN total - arc ELSE arc END <= 4 AS near FROM dl JOIN m USING (case_id))""",
        body="SELECT case_id, round(coalesce(avg(dev) FILTER (near), 0), 6) AS near, count(*) FILTER (near) AS n_near, round(coalesce(avg(dev) FILTER (NOT near), 0), 6) AS rest, count(*) FILTER (NOT near) AS n_rest FROM nr GROUP BY 1",
    ),
)
def _(spark, d):
    """The last week of a user holds the join, at its end for every other user; displacement is the distance of both coordinates."""
    t = V.traces(spark, d)
    last = t.groupBy("case_id").agg(F.max("stroke").alias("_last"))
    rows = t.join(last, "case_id").withColumn("joined", F.col("stroke") == F.col("_last"))
    j = T.displacement_at_join(rows, ["case_id"], F.abs(F.col("x") - F.col("y")), F.col("case_id") % 2 == 0, 4.0)
    return j.select("case_id", r("near").alias("near"), "n_near", r("rest").alias("rest"), "n_rest")


@query(
    "sm09_line_fits",
    V.with_views(
        V.TRACE,
        """e AS (SELECT case_id, stroke, min_by(x, pos) AS px, min_by(y, pos) AS py, max_by(x, pos) AS qx, max_by(y, pos) AS qy, count(*) AS n, avg(x) AS cx, avg(y) AS cy, covar_pop(x, y) AS c, var_pop(x) - var_pop(y) AS v FROM trace GROUP BY 1, 2),
b AS (SELECT case_id, stroke, max(abs((qx - px) * (y - py) - (qy - py) * (x - px)) / ((qx - px) ** 2 + (qy - py) ** 2)) AS bow FROM trace JOIN e USING (case_id, stroke) GROUP BY 1, 2)""",
        body="""SELECT case_id, stroke, round(CASE WHEN n < 2 OR sqrt((qx - px) ** 2 + (qy - py) ** 2) < 1e-6 THEN 'inf'::DOUBLE ELSE bow END, 6) AS bow, round(cx, 6) AS cx, round(degrees(0.5 * atan2(2 * c, v)), 4) + 0.0 AS axis_deg FROM e JOIN b USING (case_id, stroke) WHERE n > 2""",
    ),
)
def _(spark, d):
    t = V.traces(spark, d)
    n = t.groupBy(*STROKE).agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    j = G.straightness(t, STROKE).join(G.total_least_squares(t, STROKE), STROKE).join(n, STROKE, "left_semi")
    return j.select(*STROKE, r("bow").alias("bow"), r("cx").alias("cx"), r("axis_deg", 4).alias("axis_deg"))


@query(
    "sm10_direction_audit",
    V.with_views(
        V.TRACE,
        """e AS (SELECT case_id % 2 AS side, case_id // 2 AS c, stroke, min_by(x, pos) AS ax, min_by(y, pos) AS ay, max_by(x, pos) AS bx, max_by(y, pos) AS byy, count(*) AS n FROM trace GROUP BY 1, 2, 3)""",
        body="""SELECT c AS case_id, count(*) FILTER (a.n >= 2 AND b.n >= 2 AND sqrt((a.ax - b.bx) ** 2 + (a.ay - b.byy) ** 2) + sqrt((a.bx - b.ax) ** 2 + (a.byy - b.ay) ** 2) < sqrt((a.ax - b.ax) ** 2 + (a.ay - b.ay) ** 2) + sqrt((a.bx - b.bx) ** 2 + (a.byy - b.byy) ** 2)) AS flagged,
  count(*) AS compared FROM e a JOIN e b USING (c, stroke) WHERE a.side = 0 AND b.side = 1 GROUP BY 1""",
    ),
)
def _(spark, d):
    """Neighbouring cases (2k, 2k+1) stand for reference and candidate of pair k."""
    t = V.traces(spark, d).withColumn("side", F.col("case_id") % 2).withColumn("case_id", F.floor(F.col("case_id") / 2))
    return G.direction_audit(t.where("side = 0"), t.where("side = 1"), ["case_id"])


@query(
    "sm11_nib_widths",
    V.with_views(
        STEPS,
        """t AS (SELECT case_id, stroke, pos, (coalesce(nx, x) - coalesce(px, x)) AS dx, (coalesce(ny, y) - coalesce(py, y)) AS dy, px, nx FROM w0),
u AS (SELECT case_id, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE atan2(dy, dx) END - radians(40.0) AS d FROM t)""",
        body="SELECT case_id, round(avg(0.5 * (0.2 * abs(sin(d)) + 0.05 * abs(cos(d)))), 6) AS mean_width, round(max(0.5 * (0.2 * abs(sin(d)) + 0.05 * abs(cos(d)))), 6) AS max_width FROM u GROUP BY 1",
    ),
)
def _(spark, d):
    w = G.nib_widths(G.tangents(V.traces(spark, d)), 40.0, 0.2, 0.05)
    return w.groupBy("case_id").agg(r(F.avg("half_width")).alias("mean_width"), r(F.max("half_width")).alias("max_width"))


@query(
    "sm12_slant",
    V.with_views(
        V.PIXELS,
        """p AS (SELECT mask_id, x, y FROM ik), big AS (SELECT mask_id FROM p GROUP BY 1 HAVING count(*) >= 32),
c AS (SELECT mask_id, i, CAST(round_even(x + y * tan(radians(i * 0.25::DOUBLE - 30)), 0) AS BIGINT) AS col, count(*) AS k FROM p JOIN big USING (mask_id), (SELECT unnest(range(0, 241)) AS i) GROUP BY 1, 2, 3),
s AS (SELECT mask_id, i, CAST(sum(k * k) AS BIGINT) AS score FROM c GROUP BY 1, 2)""",
        body="SELECT mask_id, 90 - (i * 0.25::DOUBLE - 30) AS slant_deg, score FROM (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY score DESC, i) AS rn FROM s) WHERE rn = 1",
    ),
)
def _(spark, d):
    return G.slant(V.inks(spark, d), ["mask_id"])


@query(
    "ag47_bounding_window",
    V.with_views(
        V.PIXELS,
        body="SELECT mask_id, greatest(0, min(x) - 6) AS x0, least(64, max(x) + 6) AS x1, greatest(0, min(y) - 6) AS y0, least(64, max(y) + 6) AS y1 FROM ik GROUP BY 1",
    ),
)
def _(spark, d):
    return G.bounding_window(V.inks(spark, d), ["mask_id"], F.lit(10.0), 0.5, F.lit(64), F.lit(64))
