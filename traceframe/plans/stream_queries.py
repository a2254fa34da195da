"""Streaming jobs run over a table's files to the end, returning the resulting table."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.plans import views as V
from traceframe.plans.registry import query
from traceframe.plans.word_queries import STREAK_BODY, STREAKS
from traceframe.streaming import jobs as J


def _events(spark, d):
    return J.file_stream(spark, d, "events.parquet", V.table(spark, d, "events").schema)


@query("st_r1_live_tallies", V.with_views(STREAKS, body=STREAK_BODY))
def _(spark, d):
    e = _events(spark, d).withColumn("ok", F.col("event_type") != "error").withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.stream_tallies(e, ["user_id"], "ts", "event_id", "ok", 86400, J.work_folder(spark))
    return out.select("user_id", "seen", "correct", "streak", "best_streak")


@query(
    "st_r2_stream_upsert",
    """SELECT user_id % 8 AS part, user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(spark, d):
    folder = J.work_folder(spark)
    b = _events(spark, d).select((F.col("user_id") % 8).alias("part"), "user_id", "event_type", "event_id")
    J.stream_upserts(b, ["part", "user_id"], "event_id", "part", f"{folder}/table", f"{folder}/state")
    return spark.read.parquet(f"{folder}/table").select(F.col("part").cast("bigint").alias("part"), "user_id", "event_type", "event_id")


@query(
    "st_r3_life_cycle",
    """WITH RECURSIVE c AS (SELECT user_id AS item_id, event_id AS change_id, CASE WHEN event_id % 9 = 0 THEN 'note' END AS kind,
  CASE event_type WHEN 'signup' THEN 'ack' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'returned' WHEN 'view' THEN 'open' END AS status,
  CASE WHEN event_type = 'signup' AND event_id % 3 <> 0 THEN 'I see' END AS understanding, CASE WHEN event_type = 'signup' AND event_id % 5 <> 0 THEN 'yes' END AS reproduced,
  CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'compose' END AS stage, CASE WHEN event_type IN ('purchase', 'error') AND event_id % 7 <> 0 THEN 'fixed' END AS resolution,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
go AS (SELECT DISTINCT item_id, 0::BIGINT AS k, NULL::BIGINT AS change_id, NULL::VARCHAR AS problem, 'glyph' AS kind, 'open' AS status, NULL::VARCHAR AS understanding, NULL::VARCHAR AS reproduced, NULL::VARCHAR AS stage, NULL::VARCHAR AS resolution FROM c
  UNION ALL
  SELECT item_id, k, change_id, p, CASE WHEN p IS NULL THEN coalesce(nk, kind) ELSE kind END, CASE WHEN p IS NULL THEN coalesce(ns, status) ELSE status END, CASE WHEN p IS NULL THEN coalesce(nu, understanding) ELSE understanding END,
    CASE WHEN p IS NULL THEN coalesce(nr, reproduced) ELSE reproduced END, CASE WHEN p IS NULL THEN coalesce(ng, stage) ELSE stage END, CASE WHEN p IS NULL THEN coalesce(nn, resolution) ELSE resolution END FROM (
    SELECT g.item_id, c.k, c.change_id, g.kind, g.status, g.understanding, g.reproduced, g.stage, g.resolution, c.kind AS nk, c.status AS ns, c.understanding AS nu, c.reproduced AS nr, c.stage AS ng, c.resolution AS nn,
      CASE WHEN coalesce(c.status, '') NOT IN ('ack', 'done', 'returned') THEN CASE WHEN coalesce(c.understanding, c.reproduced, c.stage, c.resolution) IS NOT NULL THEN 'protocol_without_transition' END
        WHEN c.status <> 'ack' AND g.understanding IS NULL THEN 'not_understood'
        WHEN c.status = 'ack' THEN CASE WHEN coalesce(c.understanding, g.understanding) IS NULL OR coalesce(c.reproduced, g.reproduced) IS NULL THEN 'ack_missing' END
        WHEN coalesce(c.resolution, g.resolution) IS NULL OR (g.kind <> 'note' AND coalesce(c.stage, g.stage) IS NULL) THEN 'close_missing' END AS p
    FROM go g JOIN c ON c.item_id = g.item_id AND c.k = g.k + 1))
SELECT item_id, change_id, problem, status FROM go WHERE k > 0""",
)
def _(spark, d):
    t, m = F.col("event_type"), F.col("event_id")
    c = _events(spark, d).select(
        F.col("user_id").alias("item_id"),
        m.alias("change_id"),
        F.when(m % 9 == 0, "note").alias("kind"),
        F.when(t == "signup", "ack").when(t == "purchase", "done").when(t == "error", "returned").when(t == "view", "open").alias("status"),
        F.when((t == "signup") & (m % 3 != 0), "I see").alias("understanding"),
        F.when((t == "signup") & (m % 5 != 0), "yes").alias("reproduced"),
        F.when((t == "purchase") & (m % 2 == 0), "compose").alias("stage"),
        F.when(t.isin("purchase", "error") & (m % 7 != 0), "fixed").alias("resolution"),
    )
    folder = J.work_folder(spark)
    return J.stream_to_folder(J.life_cycle(c), f"{folder}/out", f"{folder}/state")


@query(
    "st_r4_run_log",
    "SELECT DISTINCT strftime(ts, '%Y%m%d') AS stamp, event_type AS label FROM events",
)
def _(spark, d):
    runs = _events(spark, d).select(
        F.col("ts").cast("timestamp").alias("at"), F.date_format("ts", "yyyyMMdd").alias("stamp"), F.col("event_type").alias("label")
    )
    folder = J.work_folder(spark)
    out = J.stream_to_folder(J.create_only(runs, "at", "30 days"), f"{folder}/out", f"{folder}/state")
    return out.select("stamp", "label")
