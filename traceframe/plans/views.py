"""Adapter views: the shapes the operators expect, derived from the plain tables, with the same views in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.functions.ordered import dense_position, dense_rank_of


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def with_views(*parts: str, body: str) -> str:
    """One SQL statement from view fragments and a body."""
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body


#: Tasks for each split of a scan in which its groups are formed.
TASKS_OF_SPLIT = 4


def dealt(scan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a scan by `keys`, in a number of partitions that grows with its files: for groups nearly as many as rows, which
    combining before the shuffle would only hold in memory."""
    return scan.repartition(TASKS_OF_SPLIT * scan.rdd.getNumPartitions(), *keys)


# ---------------------------------------------------------------- occurrences


def occurrences(spark: SparkSession, directory: str) -> DataFrame:
    """Embeddings as occurrences: points are coordinate pairs; some rows are one point short."""
    e = table(spark, directory, "embeddings")
    v = F.col("vec_id")
    n = F.lit(32) - F.when(v % 10 == 0, 1).otherwise(0)
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(
        v.alias("seq"),
        F.col("label").cast("string").alias("glyph_key"),
        F.lit(0).alias("variant"),
        F.element_at(F.array(F.lit("initial"), F.lit("medial"), F.lit("final")), (v % 3 + 1).cast("int")).alias(
            "position"
        ),
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(F.get(vec, 2 * i).alias("x"), F.get(vec, 2 * i + 1).alias("y")),
        ).alias("anchors"),
        F.when(v % 9 != 4, F.abs(F.get(vec, F.lit(0))) * 10).alias("geo_rmse_px"),
        (v % 7 + 40).cast("double").alias("xh_px"),
        F.concat(F.lit("s"), (v % 25).cast("string")).alias("specimen_id"),
        F.when(v % 4 == 0, F.lit("w0")).when(v % 4 < 3, F.lit("w1")).alias("owner"),
    )


OCC = """
occ AS (SELECT vec_id AS seq, CAST(label AS VARCHAR) AS glyph_key,
  CASE vec_id % 3 WHEN 0 THEN 'initial' WHEN 1 THEN 'medial' ELSE 'final' END AS "position",
  32 - CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END AS n_points, embedding AS e,
  CASE WHEN vec_id % 9 <> 4 THEN abs(CAST(embedding[1] AS DOUBLE)) * 10 END AS geo_rmse_px,
  CAST(vec_id % 7 + 40 AS DOUBLE) AS xh_px, 's' || (vec_id % 25) AS specimen_id,
  CASE WHEN vec_id % 4 = 0 THEN 'w0' WHEN vec_id % 4 < 3 THEN 'w1' END AS owner
  FROM embeddings)"""

OCC_POINTS = """
occ_modal AS (SELECT glyph_key, n_points FROM (
  SELECT glyph_key, n_points, row_number() OVER (PARTITION BY glyph_key ORDER BY count(*) DESC, min(seq)) AS rn
  FROM occ GROUP BY glyph_key, n_points) WHERE rn = 1),
occ_kept AS (SELECT occ.* FROM occ JOIN occ_modal USING (glyph_key, n_points)),
occ_pt AS (SELECT seq, glyph_key, i, CAST(e[2 * i + 1] AS DOUBLE) AS x, CAST(e[2 * i + 2] AS DOUBLE) AS y
  FROM occ_kept, (SELECT unnest(range(0, 32)) AS i) WHERE i < n_points),
occ_med AS (SELECT glyph_key, i, median(x) AS mx, median(y) AS my FROM occ_pt GROUP BY 1, 2)"""

# ---------------------------------------------------------------- transitions


def second_of_day(ts: str) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.expr(f"extract(SECOND FROM {ts})").cast("double")


def hour_bucket(ts: str) -> Column:
    return F.datediff(F.col(ts), F.lit("1970-01-01")).cast("bigint") * 24 + F.hour(ts)


def transitions(spark: SparkSession, directory: str) -> DataFrame:
    """Each event and the next one of the same user as a pair with an offset and a three-point connector."""
    from traceframe.functions.ordered import neighbours

    e = table(spark, directory, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = e.withColumn("day", F.datediff("ts", F.lit("2024-01-01")).cast("double")).withColumn(
        "h", (F.col("day") * 86400 + second_of_day("ts")) / 3600
    )
    e = dense_position(e, ["user_id"], ["ts", "event_id"], hour_bucket("ts"))
    e = neighbours(
        e, ["user_id"], "pos", {"right_key": ("event_type", 1), "h2": ("h", 1), "value2": ("value", 1)}
    ).where(F.col("right_key").isNotNull())
    dx, dy = F.col("h2") - F.col("h"), F.col("value2") - F.col("value")
    k = F.col("event_id")

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    zero = F.lit(0.0)
    return e.select(
        k.alias("seq"),
        "user_id",
        F.col("pos").alias("slot"),
        F.col("event_type").alias("left_key"),
        "right_key",
        F.when(k % 3 == 0, F.lit("pairs")).otherwise(F.lit("words")).alias("kind"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("specimen_id"),
        point(dx, dy).alias("offset"),
        F.when(k % 17 == 5, F.array(point(zero, zero)))
        .otherwise(F.array(point(zero, zero), point(dx / 2, dy + 1), point(dx, dy)))
        .alias("connector"),
        F.when(k % 29 == 3, F.lit(None).cast("boolean")).otherwise(k % 13 != 0).alias("fit_ok"),
        F.when(k % 5 != 0, F.col("value") / 10).alias("gen_chamfer"),
        F.when(k % 7 != 0, F.col("value2") / 10).alias("harvest_chamfer"),
        F.when(k % 11 != 0, F.col("value") / 100).alias("a_resid"),
        F.when(k % 3 != 0, F.col("value2") / 100).alias("b_resid"),
        F.when(k % 4 != 0, k % 8 < 3).alias("gap_ink"),
    )


PAIRS = """
ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  (CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) * 86400
   + (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(microseconds FROM ts) / 1000000.0)) / 3600 AS h
  FROM events),
ev2 AS (SELECT *, lead(event_type) OVER w AS right_key, lead(h) OVER w AS h2, lead(value) OVER w AS value2
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
tr AS (SELECT event_id AS seq, user_id, pos AS slot, event_type AS left_key, right_key,
  CASE WHEN event_id % 3 = 0 THEN 'pairs' ELSE 'words' END AS kind, 'u' || user_id AS specimen_id,
  h2 - h AS dx, value2 - value AS dy, event_id % 17 <> 5 AS good_geometry,
  CASE WHEN event_id % 29 = 3 THEN NULL ELSE event_id % 13 <> 0 END AS fit_ok,
  CASE WHEN event_id % 5 <> 0 THEN value / 10 END AS gen_chamfer,
  CASE WHEN event_id % 7 <> 0 THEN value2 / 10 END AS harvest_chamfer,
  CASE WHEN event_id % 11 <> 0 THEN value / 100 END AS a_resid,
  CASE WHEN event_id % 3 <> 0 THEN value2 / 100 END AS b_resid,
  CASE WHEN event_id % 4 <> 0 THEN event_id % 8 < 3 END AS gap_ink
  FROM ev2 WHERE right_key IS NOT NULL)"""

# --------------------------------------------------------------------- traces


def traces(spark: SparkSession, directory: str) -> DataFrame:
    """Events as point sequences: case = user, stroke = week, x from the time of day, y from the value."""
    e = table(spark, directory, "events").select("event_id", "ts", "user_id", "value")
    t = e.select(
        F.col("user_id").alias("case_id"),
        F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("bigint").alias("stroke"),
        (second_of_day("ts") / 8640).alias("x"),
        (F.col("value") / 50).alias("y"),
        "ts",
        "event_id",
    )
    t = dense_position(t, ["case_id", "stroke"], ["ts", "event_id"], hour_bucket("ts"))
    return t.select("case_id", "stroke", "pos", "x", "y")


TRACE = """
trace AS (SELECT user_id AS case_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS stroke,
  row_number() OVER (PARTITION BY user_id, floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7)
    ORDER BY ts, event_id) - 1 AS pos,
  (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(microseconds FROM ts) / 1000000.0) / 8640 AS x,
  value / 50 AS y FROM events)"""

# ----------------------------------------------------------------------- runs


def pair_side() -> Column:
    """Two sides from three return flags: lines without one are dealt to both by their number."""
    flag = F.col("l_returnflag")
    return F.when(flag.isin("A", "R"), flag).when(F.col("l_linenumber") % 2 == 1, "A").otherwise("R")


PAIR_SIDE = "CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag WHEN l_linenumber % 2 = 1 THEN 'A' ELSE 'R' END"


def run_rows(spark: SparkSession, directory: str, flag: str | None = None) -> DataFrame:
    """Bench rows per case (part) and side: measures, counters and a status."""
    li = table(spark, directory, "lineitem")
    if flag is not None:
        li = li.where(pair_side() == flag)

    def cents(c: str) -> Column:
        return F.sum(F.round(F.col(c) * 100).cast("bigint"))

    def times(k: int) -> Column:
        return F.count_if(F.col("l_linenumber") == k)

    g = li.groupBy(pair_side().alias("side"), F.col("l_partkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        cents("l_extendedprice").alias("price"),
        cents("l_discount").alias("disc"),
        cents("l_tax").alias("tax"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.sum("l_linenumber").cast("bigint").alias("lines"),
        *[times(k).alias(f"k{k}") for k in range(1, 8)],
    )
    status = F.when(F.col("n") % 7 == 0, "failed").when(F.col("n") % 5 == 0, "skipped").otherwise("ok")
    ok = F.col("status") == "ok"
    n = F.col("n").cast("double")
    g = g.withColumn("status", status)
    return g.select(
        "side",
        "id",
        "status",
        F.when(ok, F.col("price") / (n * 9999991.0)).alias("dtw_xh"),
        F.when(ok, F.col("disc") / (n * 10)).alias("aiou"),
        F.when(ok, F.col("tax") / (n * 100)).alias("chamfer_cand_ref_xh"),
        F.when(ok, F.col("qty") / (n * 50)).alias("chamfer_ref_cand_xh"),
        F.when(ok & (F.col("k1") > 0), F.col("qty") / (F.col("lines") * 5.0)).alias("retrace_arc_ratio"),
        *[
            F.when(ok, F.col(f"k{i % 7 + 1}")).alias(c)
            for i, c in enumerate(COUNTERS)
        ],
        F.when(ok, F.col("k2") > F.col("k3")).alias("dtw_reversed_better"),
        (F.col("k4") % 2 == 1).alias("marks_uncertain"),
        F.when(ok, F.col("k5") - F.col("k6")).alias("lift_delta"),
        F.when(ok, F.col("n") * 3).alias("dtw_max_absorption"),
        (F.col("lines") / 8.0).alias("secs"),
    )


COUNTERS = [
    "marks_missing", "marks_spurious", "marks_ambiguous", "cross_missing", "cross_spurious", "cross_ambiguous",
    "retrace_missing", "retrace_spurious", "touch_ref", "touch_cand", "overlap_ref", "overlap_cand",
    "direction_uncertain",
]

RUNS = (
    f"""
run_g AS (SELECT {PAIR_SIDE} AS side, l_partkey AS id, count(*) AS n,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(sum(l_linenumber) AS BIGINT) AS lines, """
    + ", ".join(f"count(*) FILTER (l_linenumber = {k}) AS k{k}" for k in range(1, 8))
    + """
  FROM lineitem GROUP BY 1, 2),
run_s AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'failed' WHEN n % 5 = 0 THEN 'skipped' ELSE 'ok' END AS status FROM run_g),
runs AS (SELECT side, id, status,
  CASE WHEN status = 'ok' THEN price / (n * 9999991.0) END AS dtw_xh,
  CASE WHEN status = 'ok' THEN disc / (n * 10.0::DOUBLE) END AS aiou,
  CASE WHEN status = 'ok' THEN tax / (n * 100.0::DOUBLE) END AS chamfer_cand_ref_xh,
  CASE WHEN status = 'ok' THEN qty / (n * 50.0::DOUBLE) END AS chamfer_ref_cand_xh,
  CASE WHEN status = 'ok' AND k1 > 0 THEN qty / (lines * 5.0::DOUBLE) END AS retrace_arc_ratio, """
    + ", ".join(f"CASE WHEN status = 'ok' THEN k{i % 7 + 1} END AS {c}" for i, c in enumerate(COUNTERS))
    + """,
  CASE WHEN status = 'ok' THEN k2 > k3 END AS dtw_reversed_better, k4 % 2 = 1 AS marks_uncertain,
  CASE WHEN status = 'ok' THEN k5 - k6 END AS lift_delta, CASE WHEN status = 'ok' THEN n * 3 END AS dtw_max_absorption,
  lines / 8.0::DOUBLE AS secs FROM run_s)"""
)


def arm_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Arms of a treatment ladder: weight from the line number, occurrence = (part, supplier third)."""
    li = table(spark, directory, "lineitem").select(
        ((F.col("l_linenumber") - 1) / 10.0).alias("weight"),
        F.col("l_partkey").alias("specimen"),
        (F.col("l_suppkey") % 3).alias("slot"),
        "l_discount",
        "l_tax",
        "l_quantity",
    )
    arm = ["weight", "specimen", "slot"]
    g = dealt(li, arm).groupBy(*arm).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("tax"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
    )
    n = F.col("n").cast("double")
    return g.select(
        "weight",
        "specimen",
        "slot",
        (F.col("qty") % 3 != 0).alias("accepted"),
        (F.col("disc") / (n * 100)).alias("off_ink_share"),
        (F.col("qty") / n).alias("geo_rmse_px"),
        (F.col("tax") / n).alias("cov_rmse_local_px"),
        F.col("qty").alias("iterations"),
        (F.col("qty") > 90).alias("hit_iteration_cap"),
        (F.col("disc") / (n * 4)).alias("anchor_spike_ratio"),
        F.col("n").alias("n_stranded"),
        (F.col("qty") % 2 == 0).alias("joined"),
        (F.col("disc") / n - F.col("tax") / n).alias("gap_y"),
        (F.col("disc") / (n * 10)).alias("y_fit"),
        (F.col("tax") / (n * 10)).alias("y_target"),
        (F.col("qty") / (n * 10)).alias("slot_dy"),
        (F.col("qty") + F.col("tax")).cast("double").alias("e_geo"),
        F.col("disc").cast("double").alias("e_landmark"),
    )


ARMS = """
arm_g AS (SELECT (l_linenumber - 1) / 10.0::DOUBLE AS weight, l_partkey AS specimen, l_suppkey % 3 AS slot, count(*) AS n,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1, 2, 3),
arms AS (SELECT weight, specimen, slot, qty % 3 <> 0 AS accepted, disc / (n * 100.0::DOUBLE) AS off_ink_share,
  qty / CAST(n AS DOUBLE) AS geo_rmse_px, tax / CAST(n AS DOUBLE) AS cov_rmse_local_px, qty AS iterations,
  qty > 90 AS hit_iteration_cap, disc / (n * 4.0::DOUBLE) AS anchor_spike_ratio, n AS n_stranded,
  qty % 2 = 0 AS joined, disc / CAST(n AS DOUBLE) - tax / CAST(n AS DOUBLE) AS gap_y, disc / (n * 10.0::DOUBLE) AS y_fit,
  tax / (n * 10.0::DOUBLE) AS y_target, qty / (n * 10.0::DOUBLE) AS slot_dy, CAST(qty + tax AS DOUBLE) AS e_geo,
  CAST(disc AS DOUBLE) AS e_landmark FROM arm_g)"""


def join_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Two-sided rows (left and right letter of a join) from order lines."""
    li = table(spark, directory, "lineitem")
    q, ln = F.col("l_quantity").cast("bigint"), F.col("l_linenumber")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("p"), (F.col("l_partkey") % 11).cast("string")).alias("chain_l_key"),
        F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit("p"), (F.col("l_suppkey") % 11).cast("string"))).alias(
            "chain_r_key"
        ),
        F.when(q % 10 != 0, q % 2 == 0).alias("base_a_converged"),
        F.when(q % 10 != 1, q % 3 == 0).alias("base_b_converged"),
        F.when(ln != 7, F.col("l_discount") > 0.04).alias("chain_l_converged"),
        F.when(ln != 6, F.col("l_tax") > 0.03).alias("chain_r_converged"),
        F.when(ln % 2 == 0, F.col("l_discount") > 0.05).alias("chain_l_converged_local"),
        F.lit(None).cast("boolean").alias("chain_r_converged_local"),
        F.when(q > 2, q.cast("double")).alias("xh_px"),
        (F.col("l_discount") * 60).alias("chain_l_geo_rmse_px"),
        (F.col("l_tax") * 60).alias("chain_r_geo_rmse_px"),
        (F.col("l_tax") * 70).alias("chain_l_cov_rmse_px"),
        F.when(ln != 3, F.col("l_discount") * 70).alias("chain_r_cov_rmse_px"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("pair"),
        F.when(ln != 5, ln < 3).alias("base_empty_join"),
        (F.col("l_discount") > 0.06).alias("chain_connector_yielded"),
    )


JOINS = """
joinrows AS (SELECT l_orderkey, l_linenumber, 'p' || (l_partkey % 11) AS chain_l_key,
  CASE WHEN l_suppkey % 9 <> 0 THEN 'p' || (l_suppkey % 11) END AS chain_r_key,
  CASE WHEN CAST(l_quantity AS BIGINT) % 10 <> 0 THEN CAST(l_quantity AS BIGINT) % 2 = 0 END AS base_a_converged,
  CASE WHEN CAST(l_quantity AS BIGINT) % 10 <> 1 THEN CAST(l_quantity AS BIGINT) % 3 = 0 END AS base_b_converged,
  CASE WHEN l_linenumber <> 7 THEN l_discount > 0.04::DOUBLE END AS chain_l_converged,
  CASE WHEN l_linenumber <> 6 THEN l_tax > 0.03::DOUBLE END AS chain_r_converged,
  CASE WHEN l_linenumber % 2 = 0 THEN l_discount > 0.05::DOUBLE END AS chain_l_converged_local,
  CAST(NULL AS BOOLEAN) AS chain_r_converged_local,
  CASE WHEN CAST(l_quantity AS BIGINT) > 2 THEN l_quantity END AS xh_px,
  l_discount * 60 AS chain_l_geo_rmse_px, l_tax * 60 AS chain_r_geo_rmse_px, l_tax * 70 AS chain_l_cov_rmse_px,
  CASE WHEN l_linenumber <> 3 THEN l_discount * 70 END AS chain_r_cov_rmse_px,
  l_returnflag || '-' || l_linestatus AS pair, CASE WHEN l_linenumber <> 5 THEN l_linenumber < 3 END AS base_empty_join,
  l_discount > 0.06::DOUBLE AS chain_connector_yielded FROM lineitem)"""

# --------------------------------------------------------------------- labels


def verdicts(spark: SparkSession, directory: str) -> DataFrame:
    """Labels as verdicts in judging order."""
    d = F.col("doc_id")
    bad = (F.col("toxic") == 1) | (d % 5 == 0)

    def code(cond: Column, c: str) -> Column:
        return F.when(cond, F.lit(c))

    solo = d % 17 == 3
    codes = F.when(solo, F.array(F.lit("K"))).otherwise(
        F.array_compact(
            F.array(
                code((F.col("quality") == 1) & ~bad, "G"),
                code(bad, "A"),
                code(F.col("quality") == 0, "W"),
                code(d % 6 == 1, "B"),
                code(d % 11 == 2, "E"),
                code(d % 13 == 4, "U"),
            )
        )
    )
    v = table(spark, directory, "labels").select(
        d.alias("doc_id"),
        F.concat(F.lit("S"), d.cast("string")).alias("uid"),
        codes.alias("codes"),
        F.when(d % 3 == 0, (d % 100).cast("int")).alias("sx"),
        F.when(d % 3 == 0, (d % 77).cast("int")).alias("sy"),
        F.when(d % 4 != 0, (d % 60 + 3).cast("int")).alias("seconds"),
        F.when(d % 50 == 7, F.lit("look again")).alias("note"),
    )
    return dense_rank_of(v, [], "doc_id", "doc_id", "position")


def label_key(spark: SparkSession, directory: str) -> DataFrame:
    """One key row per labelled document; every twentieth is a blind repeat of the one before."""
    d = F.col("doc_id")
    return table(spark, directory, "labels").select(
        F.concat(F.lit("S"), d.cast("string")).alias("uid"),
        F.concat(F.lit("g"), (d % 12).cast("string")).alias("glyph"),
        F.when(d % 20 == 1, F.concat(F.lit("S"), (d - 1).cast("string"))).alias("repeat_of"),
    )


METRICS = ["peak", "med", "p90", "spike"]


def label_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Metrics per document; some are missing."""
    d = F.col("doc_id")
    docs = table(spark, directory, "documents").join(table(spark, directory, "labels").select("doc_id"), "doc_id")
    return docs.select(
        F.concat(F.lit("S"), d.cast("string")).alias("uid"),
        F.when(d % 19 != 0, F.col("n_chars").cast("double")).alias("peak"),
        F.size(F.split("text", " ")).cast("double").alias("med"),
        (F.col("n_chars") % 97).cast("double").alias("p90"),
        F.when(d % 7 != 6, (F.col("n_chars") % 160) / 10.0).alias("spike"),
        F.when(d % 23 != 0, d % 3 == 1).alias("at_edge"),
        (d % 40).cast("int").alias("idx"),
        ((d % 40) / 40.0).alias("rel"),
        (d % 9).cast("int").alias("edge_dist"),
        (F.col("n_chars") % 40).cast("int").alias("argmax_idx"),
    ).withColumn("has_place", F.col("idx") != 13)


LABELS = """
verdict AS (SELECT doc_id, 'S' || doc_id AS uid, row_number() OVER (ORDER BY doc_id) - 1 AS "position",
  CASE WHEN doc_id % 17 = 3 THEN ['K'] ELSE list_filter([
    CASE WHEN quality = 1 AND NOT (toxic = 1 OR doc_id % 5 = 0) THEN 'G' END,
    CASE WHEN toxic = 1 OR doc_id % 5 = 0 THEN 'A' END, CASE WHEN quality = 0 THEN 'W' END,
    CASE WHEN doc_id % 6 = 1 THEN 'B' END, CASE WHEN doc_id % 11 = 2 THEN 'E' END,
    CASE WHEN doc_id % 13 = 4 THEN 'U' END], lambda c: c IS NOT NULL) END AS codes,
  CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 END AS sx, CASE WHEN doc_id % 3 = 0 THEN doc_id % 77 END AS sy,
  CASE WHEN doc_id % 4 <> 0 THEN doc_id % 60 + 3 END AS seconds,
  CASE WHEN doc_id % 50 = 7 THEN 'look again' END AS note FROM labels),
lkey AS (SELECT 'S' || doc_id AS uid, 'g' || (doc_id % 12) AS glyph,
  CASE WHEN doc_id % 20 = 1 THEN 'S' || (doc_id - 1) END AS repeat_of FROM labels),
metric AS (SELECT 'S' || doc_id AS uid, CASE WHEN doc_id % 19 <> 0 THEN CAST(n_chars AS DOUBLE) END AS peak,
  CAST(len(string_split(text, ' ')) AS DOUBLE) AS med, CAST(n_chars % 97 AS DOUBLE) AS p90,
  CASE WHEN doc_id % 7 <> 6 THEN (n_chars % 160) / 10.0::DOUBLE END AS spike,
  CASE WHEN doc_id % 23 <> 0 THEN doc_id % 3 = 1 END AS at_edge, doc_id % 40 AS idx, (doc_id % 40) / 40.0::DOUBLE AS rel,
  doc_id % 9 AS edge_dist, n_chars % 40 AS argmax_idx, doc_id % 40 <> 13 AS has_place
  FROM documents JOIN labels USING (doc_id)),
shown AS (SELECT v.*, list_filter(codes, lambda c: c IN ('A', 'W', 'B', 'E')) AS findings,
  list_contains(codes, 'K') AS unratable FROM verdict v JOIN lkey USING (uid) WHERE repeat_of IS NULL)"""

# --------------------------------------------------------------------- pixels


def pixels(spark: SparkSession, directory: str) -> DataFrame:
    """Distinct pixels per mask (supplier) and side (A = ink, R = candidate) with a mean grey value."""
    return table(spark, directory, "lineitem").groupBy(
        F.col("l_suppkey").alias("mask_id"),
        pair_side().alias("side"),
        (F.col("l_partkey") % 64).cast("int").alias("x"),
        (F.col("l_orderkey") % 64).cast("int").alias("y"),
    ).agg((F.min("l_quantity") / 50).alias("grey"))


def inks(spark: SparkSession, directory: str) -> DataFrame:
    """Both sides of every mask as masks of their own: 2 * mask, and one more for side R."""
    return pixels(spark, directory).withColumn("mask_id", 2 * F.col("mask_id") + (F.col("side") == "R").cast("int")).drop("side")


PIXELS = f"""
px AS (SELECT l_suppkey AS mask_id, {PAIR_SIDE} AS side, CAST(l_partkey % 64 AS INTEGER) AS x,
  CAST(l_orderkey % 64 AS INTEGER) AS y, min(l_quantity) / 50 AS grey FROM lineitem
  GROUP BY 1, 2, 3, 4),
ik AS (SELECT 2 * mask_id + CASE WHEN side = 'R' THEN 1 ELSE 0 END AS mask_id, x, y, grey FROM px)"""

# ---------------------------------------------------------------------- words


def words(spark: SparkSession, directory: str) -> DataFrame:
    """Every distinct word of the documents with its count."""
    d = table(spark, directory, "documents")
    # outer: a plain explode would add a size filter and run the pattern twice over every text
    w = d.select(F.explode_outer(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("word"))
    return w.where(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


WORDS = r"""
word AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents)
  GROUP BY 1)"""


def week_pairs(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every week of a user, and the week after it, as two sides of one case; `case_id` becomes 100 * user + week."""
    case = F.col("case_id") * 100 + F.col("stroke")
    return t.withColumn("case_id", case).drop("stroke"), t.where("stroke > 0").withColumn("case_id", case - 1).drop("stroke")
