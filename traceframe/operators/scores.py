"""A candidate trace against its reference: structure counters of both sides and the full score row.

Both sides are one table while they are resampled, classified and searched, told apart by a letter in front of the case; every
detector so reads both once. Matching and sums go back to the cases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions.ordered import dense_position
from traceframe.operators import cases as K
from traceframe.operators import compare as C
from traceframe.operators import geometry as G
from traceframe.operators import matching as M
from traceframe.session import checkpointed

KINDS = ("cross", "retrace", "touch", "overlap")
# Reach of marks and lifts, and how much nearer the nearest mark has to be than the next one.
MARK_RADIUS, MARK_MARGIN, LIFT_RADIUS = 0.6, 0.25, 0.6


def _both(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Both sides in one table; `case_id` becomes r or c and the case."""
    coded = lambda df, side: df.withColumn("case_id", F.concat(F.lit(side), F.col("case_id").cast("string")))
    return coded(ref, "r").unionByName(coded(cand, "c"))


def _side(df: DataFrame, side: str, case_type: str) -> DataFrame:
    """Rows of one side with the case as it was."""
    mine = df.where(F.col("case_id").startswith(side))
    return mine.withColumn("case_id", F.expr("substring(case_id, 2)").cast(case_type))


def structure_places(samples: DataFrame, step: float, in_task: int = C.SAMPLES_OF_CASE) -> tuple[DataFrame, DataFrame]:
    """(places, arcs) of sampled traces: crossings and zones with kind, number in writing order and position; arc spent retracing.

    Cases of up to `in_task` samples are searched many in a task, larger ones over all tasks.
    """

    def tell(s: K.Samples, cross: K.Crossings, zones: K.Zones, cases: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
        again = np.flatnonzero(zones.pass_class == K.CLASSES.index("retrace"))
        arc = np.bincount(s.of[zones.pass_row[again]], zones.pass_arc[again], minlength=cases)
        with_arc = np.unique(s.of[zones.pass_row[again]])
        case = np.concatenate([s.of[cross.i], s.of[zones.row], with_arc])
        kind = [*["cross"] * len(cross.i), *(K.CLASSES[k] for k in zones.kind), *["arc"] * len(with_arc)]
        no = np.concatenate([(s.idx[cross.i] << 32) + s.idx[cross.j], s.idx[zones.row], with_arc * 0])
        x, y = np.concatenate([cross.x, zones.x, arc[with_arc]]), np.concatenate([cross.y, zones.y, with_arc * 0.0])
        return case, {"kind": pa.array(kind, pa.string()), "no": pa.array(no, pa.int64()), "x": pa.array(x), "y": pa.array(y)}

    found, large = C.structure_by_case(samples, step, tell, "kind string, no bigint, x double, y double", in_task)
    places, arcs = found.where("kind <> 'arc'"), found.where("kind = 'arc'").select("case_id", F.col("x").alias("retrace_arc"))
    if large is None:
        return places, arcs
    more = _spread_places(large, step)
    return places.unionByName(more[0]), arcs.unionByName(more[1])


def _spread_places(samples: DataFrame, step: float) -> tuple[DataFrame, DataFrame]:
    """The same with every step over all tasks."""
    partners = checkpointed(M.retrace_partners(samples, C.RETRACE_PROX))
    cross = C.piercing_crossings(samples, step, partners)
    zones, passes = C.structure_zones(samples, step, partners)
    no = F.shiftleft(F.col("seg_i").cast("bigint"), 32) + F.col("seg_j")
    places = cross.select("case_id", F.lit("cross").alias("kind"), no.alias("no"), "x", "y").unionByName(
        zones.select("case_id", F.col("class").alias("kind"), F.col("component.p0").cast("bigint").alias("no"), "x", "y")
    )
    arcs = passes.where("class = 'retrace'").groupBy("case_id").agg(F.sum("arc").alias("retrace_arc"))
    return checkpointed(places), checkpointed(arcs)


def matched_structure(places: DataFrame, arcs: DataFrame, cases: DataFrame, case_type: str) -> DataFrame:
    """Counters of both sides per case: {kind}_ref, _cand, _matched, _missing, _spurious, _pos_err and the retraced arcs.

    Places of one kind are matched one to one by ascending distance within the radius. The arc ratio is null where the
    reference retraces nothing.
    """
    ref, cand = (_side(places, s, case_type).withColumnRenamed("no", n) for s, n in (("r", "ref"), ("c", "cand")))
    keys = ["case_id", "kind"]
    hits = checkpointed(M.greedy_one_to_one(ref, cand, keys, C.MATCH_RADIUS))
    counts = checkpointed(M.match_counts(ref, cand, hits, keys))
    wide = []
    for kind in KINDS:
        mine = F.col("kind") == kind
        for name in ("ref", "cand", "matched", "missing", "spurious"):
            wide.append(F.coalesce(F.max(F.when(mine, F.col(name))), F.lit(0)).cast("bigint").alias(f"{kind}_{name}"))
        wide.append(F.max(F.when(mine, F.col("median_error"))).alias(f"{kind}_pos_err"))
    out = cases.join(counts.groupBy("case_id").agg(*wide), "case_id", "left")
    for kind in KINDS:
        for name in ("ref", "cand", "matched", "missing", "spurious"):
            out = out.withColumn(f"{kind}_{name}", F.coalesce(f"{kind}_{name}", F.lit(0).cast("bigint")))
    for side, name in (("r", "retrace_arc_ref"), ("c", "retrace_arc_cand")):
        out = out.join(_side(arcs, side, case_type).withColumnRenamed("retrace_arc", name), "case_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.lit(0.0)))
    ratio = F.when(F.col("retrace_arc_ref") > 0, F.col("retrace_arc_cand") / F.col("retrace_arc_ref"))
    return out.withColumn("retrace_arc_ratio", ratio)


def two_sided_counters(ref: DataFrame, cand: DataFrame, step: float) -> DataFrame:
    """Structure of candidate traces against that of their references, one row per case of either side.

    ref and cand hold case_id, stroke, pos, x, y in one frame. Both are resampled to the same step and searched by the same
    detectors. A case of one side only has all its structure missing or spurious.
    """
    kind = dict(ref.dtypes)["case_id"]
    cases = ref.select("case_id").union(cand.select("case_id")).distinct()
    return matched_structure(*structure_places(C.sampled(_both(ref, cand), step), step), cases, kind)


def _marks(trace: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(body points with strokes numbered anew, mark centres)."""
    keys = ["case_id", "stroke"]
    body = dense_position(classes.where("NOT is_mark").select(*keys), ["case_id"], ["stroke"], F.lit(0), "_s")
    body = trace.join(body, keys).withColumn("stroke", F.col("_s")).drop("_s")
    marks = trace.join(classes.where("is_mark").select(*keys), keys, "left_semi")
    return body, marks.groupBy("case_id", "stroke").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def score_rows(
    ref: DataFrame,
    cand: DataFrame,
    step: float,
    marks_expected: DataFrame | None = None,
    ink: DataFrame | None = None,
    to_pixel: tuple[Column, Column] | None = None,
    grid: tuple[int, int] = (64, 64),
    reports: DataFrame | None = None,
) -> DataFrame:
    """One row per reference case with every measure of its candidate; both traces in one frame.

    marks_expected(case_id, marks_expected) is compared with the marks found; ink(case_id, x, y) are the pixels that the
    candidate is held against after `to_pixel` of its points; reports(case_id, status, detail) are what the provider of the
    candidates says. A case is `skipped` without a candidate, `failed` if either side has nothing but marks, or as reported.
    Such a row keeps what is known of both traces, and every measured column is null.
    """
    case_type = dict(ref.dtypes)["case_id"]
    both = checkpointed(_both(ref, cand.join(ref.select("case_id").distinct(), "case_id", "left_semi")))
    classes = checkpointed(G.stroke_classes(both))
    body, centres = (checkpointed(t) for t in _marks(both, classes))
    samples = C.sampled(both, step)

    def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return _side(df, "r", case_type), _side(df, "c", case_type)

    def size(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("case_id").agg(
            F.count(F.lit(1)).alias(f"{p}_strokes"), F.sum("n").alias(f"{p}_points"), F.count_if("is_mark").alias(f"{p}_marks")
        )

    shapes = [size(df, p) for df, p in zip(sides(classes), ("ref", "cand"))]
    # made again from the points for each side, which is less than storing the samples
    line = C.body_sequence(body, step, body_only=False)
    parts = [C.dtw(*sides(line), ["case_id"])]
    every_r, every_c = (s.select("case_id", "x", "y") for s in sides(samples))
    cham = C.chamfer(every_c, every_r, ["case_id"], 4 * step)
    parts.append(cham.withColumnsRenamed({"a_to_b": "chamfer_cand_ref", "b_to_a": "chamfer_ref_cand"}))
    if ink is not None:
        x, y = to_pixel or (F.col("x"), F.col("y"))
        px = _side(both, "c", case_type).withColumn("_x", x).withColumn("y", y).withColumn("x", F.col("_x")).drop("_x")
        dots = px.join(px.groupBy("case_id", "stroke").count().where("count = 1"), ["case_id", "stroke"], "left_semi")
        mask = C.rasterised(G.segments(px), ["case_id"], F.lit(grid[0]), F.lit(grid[1]), dots)
        mine = ink.join(px.select("case_id").distinct(), "case_id", "left_semi")
        parts.append(C.adaptive_iou(mask, mine, ["case_id"], *grid).withColumnsRenamed({"k": "aiou_k", "iou_k0": "aiou_iou_k0"}))

    mr, mc = (checkpointed(m.withColumnRenamed("stroke", n)) for m, n in zip(sides(centres), ("ref", "cand")))
    marks = M.match_counts(mr, mc, checkpointed(M.sequential_matches(mr, mc, ["case_id"], MARK_RADIUS, MARK_MARGIN)), ["case_id"])
    names = {c: f"marks_{c}" for c in ("ref", "cand", "matched", "missing", "spurious", "ambiguous")}
    parts.append(marks.withColumnsRenamed(names | {"median_error": "mark_pos_err"}))
    body_r, body_c = sides(body)
    lr, lc = (checkpointed(G.lift_points(b).withColumnRenamed("stroke", n)) for b, n in ((body_r, "ref"), (body_c, "cand")))
    lifts = M.match_counts(lr, lc, checkpointed(M.sequential_matches(lr, lc, ["case_id"], LIFT_RADIUS, 0.0)), ["case_id"])
    parts.append(
        lifts.select(
            "case_id", F.col("ref").alias("lift_ref"), F.col("cand").alias("lift_cand"), (F.col("cand") - F.col("ref")).alias("lift_delta"),
            F.col("matched").alias("lift_matched"), F.col("missing").alias("lift_unmatched_ref"), F.col("spurious").alias("lift_unmatched_cand"),
            F.col("median_error").alias("lift_pos_err"),
        )
    )
    audit = G.direction_audit(body_r, body_c, ["case_id"])
    parts.append(audit.withColumnsRenamed({"flagged": "direction_uncertain", "compared": "direction_checked"}))
    cases = checkpointed(shapes[0].select("case_id"))
    parts.append(matched_structure(*structure_places(samples, step), cases, case_type))

    out = shapes[0].join(shapes[1], "case_id", "left")
    measured = [c for p in parts for c in p.columns if c != "case_id"]
    for p in parts:  # one row per case each: the plan of the last join holds no more than that
        out = out.join(checkpointed(p), "case_id", "left")
    for n, b in (("_rb", body_r), ("_cb", body_c)):
        out = out.join(b.select("case_id").distinct().withColumn(n, F.lit(True)), "case_id", "left")
    none = lambda side: F.lit(f"{side} has no body stroke (everything classified as a mark)")
    detail = F.when(F.col("cand_strokes").isNull(), "no candidate").when(F.col("_rb").isNull(), none("reference")).when(F.col("_cb").isNull(), none("candidate"))
    status = F.when(F.col("cand_strokes").isNull(), "skipped").when(F.col("_rb").isNull() | F.col("_cb").isNull(), "failed").otherwise("ok")
    if reports is not None:
        told = reports.select("case_id", F.col("status").alias("_status"), F.col("detail").alias("_detail"))
        out = out.join(told, "case_id", "left")
        bad = F.col("_status") != "ok"
        detail, status = F.when(bad, F.col("_detail")).otherwise(detail), F.when(bad, F.col("_status")).otherwise(status)
    out = out.withColumn("status", status).withColumn("detail", detail)
    counted = {c for c, t in out.dtypes if t == "bigint"} - {"aiou_k", "path_len", "max_absorption"}
    ok = F.col("status") == "ok"
    values = {c: F.when(ok, F.coalesce(c, F.lit(0).cast("bigint")) if c in counted else F.col(c)) for c in measured}
    known = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("cand_strokes", "cand_points", "cand_marks")}
    out = out.withColumns(values | known).drop("_rb", "_cb", "_status", "_detail")
    if marks_expected is not None:
        out = out.join(marks_expected.select("case_id", F.col("marks_expected").cast("bigint").alias("marks_expected")), "case_id", "left")
        out = out.withColumn("marks_expected", F.coalesce("marks_expected", F.lit(0).cast("bigint")))
        out = out.withColumn("marks_uncertain", F.col("ref_marks") != F.col("marks_expected"))
    return out
