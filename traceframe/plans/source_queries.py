"""Queries for readers and table updates; the batches are derived from the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions.stats import r
from traceframe.plans import views as V
from traceframe.plans.registry import query
from traceframe.session import checkpointed
from traceframe.sources import json_ranges as Jr
from traceframe.sources import readers as Rd
from traceframe.sources import writers as Wr
from traceframe.streaming.jobs import work_folder


@query(
    "sc02_json_artifact",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 0""",
)
def _(spark, d):
    e = V.table(spark, d, "events")
    # one document per event: an object with a list of one object and one stray scalar; every third is malformed
    doc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"rows": ['), "props")).otherwise(
        F.concat(F.lit('{"rows": ['), "props", F.lit(", 7]}"))
    )
    rows, _ = Rd.json_objects(e.select(F.col("event_id").alias("path"), doc.alias("value")), "rows", "k BIGINT")
    return rows.select(F.col("path").alias("event_id"), F.col("row.k").alias("k"))


@query(
    "sc02_split_document",
    """SELECT event_id, user_id, event_type, value, props, 'events' AS frame FROM events""",
)
def _(spark, d):
    # few long documents, read back in ranges
    columns = ("event_id", "user_id", "event_type", "value", "props")
    folder = work_folder(spark)
    Jr.write_json_rows(V.table(spark, d, "events").select(*columns), folder, frame="events")
    rows, _ = Jr.json_rows(spark, folder, "rows", "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, props STRING", 1 << 20)
    return rows.select("row.*", "frame")


@query(
    "sc03_reference_set",
    """SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 2 THEN 'frame_stale' WHEN l.doc_id IS NULL THEN 'no_entry' WHEN n_chars < 50 THEN 'no_strokes' WHEN n_chars % 5 = 0 THEN 'no_registration' END AS reason,
  b.item_id IS NULL AS late FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
)
def _(spark, d):
    docs = V.table(spark, d, "documents")
    pt = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))
    rows = docs.select(
        F.col("doc_id").alias("specimen_id"),
        F.col("doc_id").alias("place"),
        F.when(F.col("doc_id") % 10 == 2, "baseline moved").alias("frame_stale"),
        F.when(F.col("n_chars") >= 50, F.array(pt)).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>")).alias("strokes"),
        F.when(F.col("n_chars") % 5 != 0, F.lit(40.0)).alias("baseline_row"),
        F.lit(30.0).alias("xh_px"),
    )
    entries = V.table(spark, d, "labels").select(F.col("doc_id").alias("specimen_id"))
    manifest = V.table(spark, d, "benchmark").select(F.col("item_id").alias("specimen_id"), (-F.col("item_id")).alias("rank"))
    ref = Rd.reference_set(rows, entries, manifest)
    return ref.select(F.col("specimen_id").alias("doc_id"), "reason", (F.col("order_key.late") == 1).alias("late"))


@query(
    "sc04_sidecar",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag AS word, CASE WHEN l_linenumber = 2 THEN 'a/b.png' ELSE 'p' || l_linenumber || '.png' END AS page,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(round_even(l_quantity + 0.5, 0) AS INTEGER) END AS x0, CAST(round_even(l_quantity + l_tax * 100, 0) AS INTEGER) AS x1,
  CAST(round_even(l_discount * 1000, 0) AS INTEGER) AS base FROM lineitem)
SELECT l_orderkey, l_linenumber, x0, x1, CASE WHEN x0 IS NULL THEN 'number' WHEN x1 <= x0 THEN 'extent' WHEN base <= 20 THEN 'band' WHEN l_linenumber = 2 THEN 'page' END AS reason FROM s""",
)
def _(spark, d):
    li = V.table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    raw = li.select(
        "l_orderkey",
        "l_linenumber",
        F.lit("").alias("id"),
        F.col("l_returnflag").alias("word"),
        F.when(n == 2, "a/b.png").otherwise(F.concat(F.lit("p"), n.cast("string"), F.lit(".png"))).alias("page"),
        F.when(n == 3, "wide").otherwise((F.col("l_quantity") + 0.5).cast("string")).alias("x0"),
        (F.col("l_quantity") + F.col("l_tax") * 100).cast("string").alias("x1"),
        F.lit("0").alias("y0"),
        F.lit("90.4").alias("y1"),
        (F.col("l_discount") * 1000).cast("string").alias("baseline_y"),
        F.lit("20").alias("midband_y"),
    )
    good, bad = Rd.sidecar_samples(raw)
    out = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return out.select("l_orderkey", "l_linenumber", "x0", "x1", "reason")


@query(
    "sc05_candidate_rows",
    """WITH w AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_tax END AS xh, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS rn
  FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2))
SELECT w.id, xh AS xh_px, CASE WHEN c.id IS NULL THEN 'skipped' ELSE 'ok' END AS status FROM w LEFT JOIN c ON c.id = w.id AND rn = 1""",
)
def _(spark, d):
    li = V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    reg = F.lit(None).cast("struct<tx:double,ty:double,baseline_row:double>")
    even = F.col("l_linenumber") % 2 == 0
    rows = li.select(
        F.col("l_orderkey").cast("string").alias("specimen_id"),
        F.col("l_linenumber").alias("place"),
        F.lit(None).cast("array<array<array<double>>>").alias("strokes"),
        reg.alias("registration_px"),
        F.when(~even, F.col("t")).alias("xh_px"),
        F.struct(reg.alias("registration_px"), F.when(even, F.col("q")).alias("xh_px")).alias("measurements"),
    )
    wanted = V.table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("specimen_id"))
    c, _ = Rd.candidates_of(rows, wanted)
    return c.select(F.col("specimen_id").cast("bigint").alias("id"), "xh_px", "status")


def verdict_text_lines(spark, d):
    """Labels written as numbered result lines, one text per last digit of the position, some with a wrong header."""
    v = V.verdicts(spark, d)
    path = F.col("position") % 10
    body = F.concat(
        F.col("uid"),
        F.lit(":"),
        F.when(F.size("codes") == 0, "-").otherwise(F.array_join("codes", "")),
        F.when(F.col("sx").isNotNull(), F.concat(F.lit("#"), F.col("sx").cast("string"), F.lit(","), F.col("sy").cast("string"))).otherwise(""),
        F.when(F.col("seconds").isNotNull(), F.concat(F.lit("@"), F.col("seconds").cast("string"), F.lit("s"))).otherwise(""),
        F.when(F.col("note").isNotNull(), F.concat(F.lit(' "'), "note", F.lit('"'))).otherwise(""),
    )
    lines = v.select(path.alias("path"), (F.floor(F.col("position") / 10) + 1).cast("int").alias("line"), body.alias("value"))
    n = v.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))
    claimed = F.col("n") + F.when(F.col("path") == 3, 1).otherwise(0)
    head = n.select("path", F.lit(0).alias("line"), F.concat(F.lit("R1 geprueft="), claimed.cast("string"), F.lit(" von "), F.col("n").cast("string")).alias("value"))
    tally = v.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("codes", "G")).alias("g")).select(
        "path", (F.col("n") + 1).cast("int").alias("line"), F.concat(F.lit("Gut: "), (F.col("g") + F.when(F.col("path") == 5, 1).otherwise(0)).cast("string")).alias("value")
    )
    return head.unionByName(lines).unionByName(tally)


@query(
    "sc06_verdict_text",
    V.with_views(
        V.LABELS,
        body="""SELECT uid, array_to_string(codes, '') AS codes, CAST(sx AS INTEGER) AS sx, CAST(sy AS INTEGER) AS sy, CAST(seconds AS INTEGER) AS seconds, note FROM verdict""",
    ),
)
def _(spark, d):
    _, verdicts, _ = Rd.parse_verdicts(verdict_text_lines(spark, d))
    return verdicts.select("uid", F.array_join("codes", "").alias("codes"), "sx", "sy", "seconds", "note")


@query("sc06_verdict_errors", "SELECT * FROM (VALUES (3, 'header_count'), (5, 'tally_count')) t(path, error)")
def _(spark, d):
    _, _, errors = Rd.parse_verdicts(verdict_text_lines(spark, d))
    return errors.select(F.col("path").cast("int").alias("path"), "error")


KERNEL = Rd.gaussian_kernel((Rd.BLOCK - 1) / 6.0)


def grey_grid(spark, d):
    """Every mask as a dense 64 x 64 grid: ink pixels keep their grey, the rest is paper."""
    px = V.inks(spark, d)
    # a column of at most 64 pixels is one row until its cells are spread
    lines = px.groupBy("mask_id", "x").agg(F.map_from_entries(F.collect_list(F.struct("y", "grey"))).alias("_line"))
    cells = px.select("mask_id").distinct().select("mask_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    grid = cells.join(lines, ["mask_id", "x"], "left").select("mask_id", "x", "_line", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("y"))
    grey = F.coalesce(F.try_element_at("_line", F.col("y")), F.lit(1.0))
    return grid.select("mask_id", "x", "y", grey.alias("grey"), F.lit(64).alias("width"), F.lit(64).alias("height"))


@query(
    "sc07_adaptive_threshold",
    V.with_views(
        V.PIXELS,
        """g AS (SELECT c.mask_id, c.x, c.y, coalesce(grey, 1.0::DOUBLE) AS grey FROM (SELECT mask_id, x, y FROM (SELECT DISTINCT mask_id FROM ik), (SELECT unnest(range(64))::INTEGER AS x), (SELECT unnest(range(64))::INTEGER AS y)) c
  LEFT JOIN ik p USING (mask_id, x, y)),
k AS (SELECT unnest(range(-33, 34)) AS o, unnest([""" + ", ".join(f"{w!r}::DOUBLE" for w in KERNEL) + """]) AS w),
src AS (SELECT t, CASE WHEN t + o < 0 THEN -1 - t - o WHEN t + o > 63 THEN 127 - t - o ELSE t + o END AS s, sum(w) AS w FROM (SELECT unnest(range(64)) AS t), k GROUP BY 1, 2),
h AS (SELECT mask_id, y, t AS x, sum(w * grey) AS v FROM g JOIN src ON src.s = g.x GROUP BY 1, 2, 3),
hv AS (SELECT mask_id, x, t AS y, sum(w * v) AS v FROM h JOIN src ON src.s = h.y GROUP BY 1, 2, 3)""",
        body="SELECT g.mask_id, count(*) AS ink, round(avg(v), 6) AS mean_local FROM g JOIN hv USING (mask_id, x, y) WHERE grey < v - 0.03 GROUP BY 1",
    ),
)
def _(spark, d):
    ink = Rd.adaptive_ink(grey_grid(spark, d))
    return ink.groupBy("mask_id").agg(F.count(F.lit(1)).alias("ink"), r(F.avg("local")).alias("mean_local"))


# --------------------------------------------------------------------- updates


@query(
    "sk01_union_of_columns",
    """SELECT 'bench' AS source, id, CAST(NULL AS VARCHAR) AS note FROM (SELECT l_partkey AS id FROM lineitem) UNION ALL SELECT 'order', o_orderkey, o_orderpriority FROM orders""",
)
def _(spark, d):
    a = V.table(spark, d, "lineitem").select(F.lit("bench").alias("source"), F.col("l_partkey").alias("id"))
    b = V.table(spark, d, "orders").select(F.lit("order").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("note"))
    return Wr.union_of_columns(a, b)


@query(
    "sk01_written_and_read",
    """SELECT 'csv' AS form, 'bench' AS source, id, CAST(NULL AS VARCHAR) AS note FROM (SELECT l_partkey AS id FROM lineitem) UNION ALL SELECT 'csv', 'order', o_orderkey, o_orderpriority FROM orders
UNION ALL SELECT 'json', 'bench', l_partkey, NULL FROM lineitem UNION ALL SELECT 'json', 'order', o_orderkey, o_orderpriority FROM orders""",
)
def _(spark, d):
    a = V.table(spark, d, "lineitem").select(F.lit("bench").alias("source"), F.col("l_partkey").alias("id"))
    b = V.table(spark, d, "orders").select(F.lit("order").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("note"))
    rows, folder = Wr.union_of_columns(a, b), work_folder(spark)
    Wr.write_csv(rows, f"{folder}/rows.csv")
    Wr.write_json(rows, f"{folder}/rows.json")
    csv = spark.read.schema(rows.schema).option("header", True).csv(f"{folder}/rows.csv")
    json = spark.read.schema(rows.schema).json(f"{folder}/rows.json")
    return csv.select(F.lit("csv").alias("form"), "*").unionByName(json.select(F.lit("json").alias("form"), "*"))


@query(
    "sk02_filed_snapshots",
    """SELECT 's2' AS stamp, 'orders' AS "table", count(*) AS rows, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS before, true AS refused_twice, true AS refused_smaller FROM orders
UNION ALL SELECT 's2', 'customer', count(*), count(*), true, true FROM customer UNION ALL SELECT 's2', 'lineitem', count(*), count(*), true, true FROM lineitem""",
)
def _(spark, d):
    """Two snapshots of growing tables; the second stamp again and a shrunken state are refused."""
    root = work_folder(spark)
    now = {n: V.table(spark, d, n) for n in ("orders", "customer", "lineitem")}
    earlier = now | {"orders": now["orders"].where("o_orderstatus <> 'P'")}
    primary = ["orders", "lineitem"]

    def refused(tables: dict, stamp: str, kind: type) -> bool:
        try:
            Wr.export_snapshot(spark, tables, root, stamp, primary)
        except kind:
            return True
        return False

    Wr.export_snapshot(spark, earlier, root, "s1", primary)
    Wr.export_snapshot(spark, now, root, "s2", primary)
    twice = refused(now, "s2", FileExistsError)
    smaller = refused(now | {"orders": now["orders"].where("false")}, "s3", ValueError)
    first = spark.read.schema("table STRING, rows BIGINT, stamp STRING").parquet(f"{root}/manifest").where("stamp = 's1'")
    last = Wr.latest_manifest(spark, root).join(first.select("table", F.col("rows").alias("before")), "table")
    return last.select(F.lit("s2").alias("stamp"), "table", "rows", "before", F.lit(twice).alias("refused_twice"), F.lit(smaller).alias("refused_smaller"))


@query(
    "sk02_plausibility",
    """SELECT 'events_with_raw' AS "table", 'no_raw_paths' AS problem UNION ALL SELECT 'nation', 'shrank' UNION ALL SELECT 'ghosts', 'empty'""",
)
def _(spark, d):
    raw = V.table(spark, d, "events").where("props IS NULL")
    tables = {n: V.table(spark, d, n) for n in ("orders", "nation", "events")}
    counts = Wr.table_counts({**tables, "events_with_raw": raw})
    previous = Wr.table_counts({"nation": tables["nation"].unionByName(tables["nation"]), "orders": tables["orders"]})
    return Wr.plausibility(counts, previous, ["orders", "ghosts"], "events_with_raw")


def _batch(spark, d):
    """Stored half of the orders and an incoming batch (order lines as repeated writes of an order)."""
    o = V.table(spark, d, "orders")
    stored = o.where("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("note"), F.lit(1).cast("bigint").alias("version")
    )
    li = V.table(spark, d, "lineitem")
    seq = F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 1000
    key = F.col("l_orderkey")
    batch = li.groupBy(key.alias("id"), seq.alias("seq")).agg(F.max("l_partkey").alias("version")).select(
        "id", (F.col("id") % 100).alias("owner"), F.concat(F.lit("w"), F.col("seq").cast("string")).alias("note"), "version", "seq"
    )
    return stored, batch


BATCH = """
stored AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderpriority AS note, CAST(1 AS BIGINT) AS version FROM orders WHERE o_orderstatus <> 'O'),
batch AS (SELECT l_orderkey AS id, l_orderkey % 100 AS owner, 'w' || (l_linenumber * 1000 + l_suppkey % 1000) AS note, max(l_partkey) AS version, l_linenumber * 1000 + l_suppkey % 1000 AS seq
  FROM lineitem GROUP BY l_orderkey, l_linenumber * 1000 + l_suppkey % 1000),
lastb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM batch) WHERE rn = 1)"""


@query(
    "sk03_keyed_upsert",
    V.with_views(
        BATCH,
        body="""SELECT id, CASE WHEN s.id IS NULL THEN b.owner ELSE s.owner END AS owner, CASE WHEN b.id IS NULL THEN s.note ELSE b.note END AS note, CASE WHEN b.id IS NULL THEN s.version ELSE b.version END AS version
FROM stored s FULL OUTER JOIN lastb b USING (id)""",
    ),
)
def _(spark, d):
    stored, batch = _batch(spark, d)
    return Wr.upserted(stored, batch, ["id"], "seq", update=["note", "version"])


@query(
    "sk04_partial_update",
    V.with_views(
        BATCH,
        body="""SELECT id, coalesce(CASE WHEN b.seq % 3 <> 0 THEN b.note END, s.note, 'none') AS note, coalesce(CASE WHEN b.seq % 2 = 0 THEN b.version END, s.version, 0) AS version FROM stored s FULL OUTER JOIN lastb b USING (id)""",
    ),
)
def _(spark, d):
    stored, batch = _batch(spark, d)
    last = Wr.last_per_key(batch, ["id"], "seq")
    payload = last.select("id", F.when(F.col("seq") % 3 != 0, F.col("note")).alias("note"), F.when(F.col("seq") % 2 == 0, F.col("version")).alias("version"))
    return Wr.partially_updated(stored, payload, ["id"], {"note": F.lit("none"), "version": F.lit(0)})


def _provenance_batch(spark, d):
    o = V.table(spark, d, "orders")
    prov = F.when(F.col("o_orderpriority") == "1-URGENT", "authored").otherwise("traced")
    stored = o.where("o_orderstatus <> 'O'").select(
        (F.col("o_custkey") % 10).alias("owner"), F.col("o_orderkey").alias("id"), prov.alias("provenance"), F.lit("old").alias("body")
    )
    li = V.table(spark, d, "lineitem")
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"))
    batch = lines.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") % 10).alias("owner"),
        F.col("l_orderkey").alias("id"),
        F.when(F.col("s") % 5 == 0, "authored").otherwise("traced").alias("provenance"),
        F.concat(F.lit("b"), F.col("l_linenumber").cast("string")).alias("body"),
        F.col("l_linenumber").alias("seq"),
    )
    return stored, batch


PROVENANCE = """
stored AS (SELECT o_custkey % 10 AS owner, o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'authored' ELSE 'traced' END AS provenance, 'old' AS body FROM orders WHERE o_orderstatus <> 'O'),
batch AS (SELECT o_custkey % 10 AS owner, l_orderkey AS id, CASE WHEN s % 5 = 0 THEN 'authored' ELSE 'traced' END AS provenance, 'b' || l_linenumber AS body, l_linenumber AS seq
  FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2) JOIN orders ON o_orderkey = l_orderkey),
fa AS (SELECT owner, id, min(seq) AS f FROM batch WHERE provenance = 'authored' GROUP BY 1, 2),
bb AS (SELECT b.*, b.provenance = 'traced' AND (s.id IS NOT NULL OR coalesce(b.seq > f, false)) AS skip FROM batch b LEFT JOIN fa USING (owner, id)
  LEFT JOIN (SELECT owner, id FROM stored WHERE provenance = 'authored') s USING (owner, id)),
nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, id ORDER BY seq DESC) AS rn FROM bb WHERE NOT skip) WHERE rn = 1)"""


@query(
    "sk05_protected_replace",
    V.with_views(
        PROVENANCE,
        body="""SELECT owner, id, provenance, body FROM nw UNION ALL SELECT owner, id, provenance, body FROM stored s
WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.owner = s.owner AND nw.id = s.id) AND (provenance = 'authored' OR owner NOT IN (SELECT owner FROM batch))""",
    ),
)
def _(spark, d):
    return Wr.protected_replace(*_provenance_batch(spark, d), "owner", ["id"], "seq", True)[0]


@query(
    "sk05_protected_counts",
    V.with_views(
        PROVENANCE,
        body="""SELECT o.owner, (SELECT count(*) FROM nw WHERE nw.owner = o.owner) AS stored, (SELECT count(*) FROM stored s WHERE s.owner = o.owner AND provenance = 'traced') AS deleted,
  (SELECT count(*) FROM bb WHERE bb.owner = o.owner AND skip) AS skipped FROM (SELECT DISTINCT owner FROM batch) o""",
    ),
)
def _(spark, d):
    return Wr.protected_replace(*_provenance_batch(spark, d), "owner", ["id"], "seq", True)[1]


@query("sk06_delete_by_predicate", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 7 = 1)")
def _(spark, d):
    o = V.table(spark, d, "orders")
    kept, _ = Wr.without_matching(o, (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 7 == 1))
    return kept.select("o_orderkey")


@query(
    "sk06_deleted_rows",
    """SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = 1) AS deleted FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 7 = 1)""",
)
def _(spark, d):
    path = f"{work_folder(spark)}/orders"
    V.table(spark, d, "orders").write.parquet(path)
    n = Wr.delete_rows(spark, path, (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 7 == 1))
    return spark.read.parquet(path).select("o_orderkey", F.lit(n).cast("bigint").alias("deleted"))


@query(
    "sk07_rebuild_per_owner",
    """WITH st AS (SELECT o_custkey % 20 AS owner, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1, 2),
rc AS (SELECT o_custkey % 20 AS owner, o_orderpriority AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 20 < 5 AND o_totalprice > 490000 GROUP BY 1, 2)
SELECT * FROM rc UNION ALL SELECT * FROM st WHERE owner NOT IN (SELECT owner FROM rc)""",
)
def _(spark, d):
    o = V.table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("owner"), F.col("o_orderpriority").alias("key"), "o_orderstatus", "o_totalprice")
    stored = o.groupBy("owner", "key").agg(F.count(F.lit(1)).alias("n"))
    again = o.where("o_orderstatus = 'F' AND owner < 5 AND o_totalprice > 490000").groupBy("owner", "key").agg(F.count(F.lit(1)).alias("n"))
    return Wr.rebuilt_for_owner(stored, again, "owner")


@query("sk08_restore_columns", "SELECT o_custkey, o_totalprice, 'restored' AS origin FROM orders")
def _(spark, d):
    o = V.table(spark, d, "orders")
    return Wr.restored_columns(o, ["o_orderkey", "o_custkey", "o_totalprice", "origin", "new_column"], ["o_orderkey"], {"origin": F.lit("restored")})


@query(
    "sk08_restored_tables",
    """WITH c AS (SELECT c_custkey AS old, (SELECT max(c_custkey) FROM customer WHERE c_custkey % 2 = 0) + row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 2 = 1),
o AS (SELECT o_orderkey AS old, o_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey % 2 = 0) + row_number() OVER (ORDER BY o_orderkey) AS k FROM orders WHERE o_custkey % 2 = 1)
SELECT 'customer' AS "table", k AS key, CAST(NULL AS BIGINT) AS parent, 1 AS n FROM c UNION ALL SELECT 'orders', o.k, c.k, 1 FROM o JOIN c ON c.old = o.o_custkey
UNION ALL SELECT 'lineitem', NULL, o.k, count(*) FROM lineitem JOIN o ON o.old = l_orderkey GROUP BY o.k
UNION ALL SELECT 'customer', c_custkey, NULL, 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'orders', o_orderkey, o_custkey, 1 FROM orders WHERE o_custkey % 2 = 0
UNION ALL SELECT 'lineitem', NULL, l_orderkey, count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 2 = 0 GROUP BY l_orderkey""",
)
def _(spark, d):
    """Customers with odd keys, their orders and lines are filed, then restored beside the others: keys made anew, no reference lost."""
    c = V.table(spark, d, "customer").select("c_custkey", "c_name")
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    odd = {"customer": c.where("c_custkey % 2 = 1"), "orders": o.where("o_custkey % 2 = 1"), "lineitem": li.where("o_custkey % 2 = 1").drop("o_custkey")}
    even = {"customer": c.where("c_custkey % 2 = 0"), "orders": o.where("o_custkey % 2 = 0"), "lineitem": li.where("o_custkey % 2 = 0").drop("o_custkey")}
    root = work_folder(spark)
    Wr.export_snapshot(spark, odd, root, "s1", ["customer", "orders"])
    filed = {n: spark.read.parquet(f"{root}/snapshots/stamp=s1/{n}") for n in odd}
    keys, links = {"customer": "c_custkey", "orders": "o_orderkey"}, {"orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders"}}
    for name, df in Wr.with_new_keys(filed, even, keys, links).items():
        even[name].select(df.columns).unionByName(df).write.parquet(f"{root}/store/{name}")
    back = {n: spark.read.parquet(f"{root}/store/{n}") for n in odd}
    none, one = F.lit(None).cast("bigint"), F.lit(1).cast("bigint")
    lines = back["lineitem"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return (
        back["customer"].select(F.lit("customer").alias("table"), F.col("c_custkey").alias("key"), none.alias("parent"), one.alias("n"))
        .unionAll(back["orders"].select(F.lit("orders"), "o_orderkey", "o_custkey", one))
        .unionAll(lines.select(F.lit("lineitem"), none, "l_orderkey", "n"))
    )


@query(
    "sk09_filed_runs",
    """SELECT 'all-' || lower(coalesce(nullif(regexp_replace(l_returnflag, '[^A-Za-z]', '', 'g'), ''), 'x')) AS label, count(*) AS artifacts, true AS refused_twice FROM (SELECT DISTINCT l_returnflag, l_suppkey FROM lineitem) GROUP BY 1""",
)
def _(spark, d):
    """One run for each return flag, its suppliers' line counts as artifacts; every run is filed once and refused after that."""
    root = work_folder(spark)
    li = V.table(spark, d, "lineitem")
    art = li.groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).cast("string").alias("body"))
    art = checkpointed(art.withColumn("name", F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string"), F.lit(".txt"))))
    twice = True
    for flag in ("A", "N", "R"):
        mine = art.where(F.col("l_returnflag") == flag).select("name", "body")
        Wr.append_run(spark, root, mine, "20240101", f"All / {flag}")
        try:
            Wr.append_run(spark, root, mine, "20240101", f"all {flag}!")
            twice = False
        except FileExistsError:
            pass
    index = spark.read.parquet(f"{root}/index")
    runs = spark.read.parquet(f"{root}/runs").groupBy("label").agg(F.count(F.lit(1)).alias("artifacts"))
    return runs.join(index.select("label"), "label").withColumn("refused_twice", F.lit(twice))


@query(
    "sk09_log_slug",
    """SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS label FROM pages""",
)
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", Wr.slug(F.col("url")).alias("label"))


@query("sk10_reseeded_table", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, d):
    """A table of finished orders is replaced by the whole content of a file; a second reseed changes nothing."""
    root = work_folder(spark)
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    Wr.write_json(o, f"{root}/seed.json")
    V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(o.columns).write.parquet(f"{root}/table")
    for _ in range(2):
        Wr.reseed(spark.read.schema(o.schema).json(f"{root}/seed.json"), f"{root}/table")
    return spark.read.parquet(f"{root}/table")


@query("sk10_full_reseed", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    return V.table(spark, d, "nation").select("n_nationkey", "n_name")


@query(
    "sk11_lean_export",
    """SELECT l_orderkey, l_linenumber, l_quantity AS fit, l_tax AS cov FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(spark, d):
    li = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"),
        F.struct(F.col("l_quantity").alias("fit"), F.col("l_tax").alias("cov"), F.col("l_discount").alias("noise")).alias("measurements"),
    )
    ids = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    out = Wr.lean_export(li, ["A", "R"], ids, "l_orderkey", ["fit", "cov"])
    return out.select("l_orderkey", "l_linenumber", "measurements.fit", "measurements.cov")
