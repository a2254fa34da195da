"""Predicates, triage and tolerant comparisons. A reason is a column, never an exception."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STROKES = 128
MIN_STROKE_POINTS = 2
MAX_STROKE_POINTS = 4096
MAX_ABS_COORD = 100.0
BASELINE_TOLERANCE = 4.0
XHEIGHT_TOLERANCE = 0.51
SPIKE_LIMIT = 8.0


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds; null when none does. A null condition does not hold."""
    out = None
    for name, cond in rules:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def triage(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, counts per reason)."""
    tagged = df.withColumn("reason", first_reason(rules))
    dropped = tagged.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return tagged.where(F.col("reason").isNull()).drop("reason"), dropped


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """Conjunction of equality filters; a None argument does not filter."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def key_lookup(df: DataFrame, keys: DataFrame, on: Sequence[str], approved_only: bool = False) -> DataFrame:
    """Rows whose key tuple is wanted, optionally only the approved ones."""
    hits = df.join(keys.select(*on).distinct(), list(on), "left_semi")
    return hits.where("approved") if approved_only else hits


def unknown_keys(df: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are not in the registry."""
    return df.select(key).distinct().join(registry.select(key), key, "left_anti")


def key_mismatch(df: DataFrame, registry: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text is registered under another key, or whose key belongs to a registered text but the text is not."""
    expected = registry.select(F.col(text), F.col(key).alias("_expected"))
    owned = registry.select(F.col(key), F.lit(True).alias("_owned")).distinct()
    j = df.join(expected, text, "left").join(owned, key, "left")
    bad = F.when(F.col("_expected").isNotNull(), F.col("_expected") != F.col(key)).otherwise(F.col("_owned"))
    return j.where(F.coalesce(bad, F.lit(False))).withColumnRenamed("_expected", "expected").drop("_owned")


def stroke_violation(strokes: Column) -> Column:
    """Why nested strokes ARRAY<ARRAY<STRUCT<x, y>>> cannot be stored: first bad stroke, first bad rule."""
    def problem(s: Column) -> Column:
        return (
            F.when(s.isNull(), "not_a_list")
            .when((F.size(s) < MIN_STROKE_POINTS) | (F.size(s) > MAX_STROKE_POINTS), "points")
            .when(F.exists(s, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull()), "coordinate")
            .when(
                ~F.forall(s, lambda p: (F.abs(p["x"]) <= MAX_ABS_COORD) & (F.abs(p["y"]) <= MAX_ABS_COORD)), "range"
            )
        )

    found = F.transform(
        strokes, lambda s, i: F.when(problem(s).isNotNull(), F.concat(F.lit("stroke "), i.cast("string"), F.lit(": "), problem(s)))
    )
    return (
        F.when(strokes.isNull() | (F.size(strokes) == 0), "no strokes")
        .when(F.size(strokes) > MAX_STROKES, "too many strokes")
        .otherwise(F.get(F.array_compact(found), F.lit(0)))
    )


def frame_violation(scale: Column, baseline: Column) -> Column:
    """Why a stored frame is unusable."""
    return first_reason([("no_baseline", baseline.isNull()), ("scale", scale.isNull() | ~(scale > 0))])


def stale_reason(entry_id: Column, baseline_row: Column, ty: Column, xh: Column, want_base: Column, want_xh: Column) -> Column:
    """Why a stored trace no longer fits its reference entry."""
    return first_reason(
        [
            ("no_entry", entry_id.isNull()),
            ("no_registration", baseline_row.isNull() | xh.isNull()),
            ("baseline", F.abs(baseline_row + F.coalesce(ty, F.lit(0.0)) - want_base) > BASELINE_TOLERANCE),
            ("xheight", F.abs(xh - want_xh) > XHEIGHT_TOLERANCE),
        ]
    )


def letter_gate(rmse_max: Column) -> Column:
    """`ok` or the first failed gate of a fitted letter."""
    reason = first_reason(
        [
            ("not_converged_local", ~F.coalesce(F.col("converged_local"), F.lit(False))),
            ("geo_rmse", F.col("geo_rmse_px") > rmse_max),
            ("at_bound", F.col("at_bound")),
            ("anchor_count", ~F.col("anchors_ok")),
            ("anchor_spike", F.col("spike_ratio") > SPIKE_LIMIT),
            ("connector_degenerate", F.col("connector_reason").isNotNull()),
        ]
    )
    return F.coalesce(reason, F.lit("ok"))


SEAM_BAND = 0.4


def connector_signals(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arc, chord, net progress, seam shares, backward share and gap per connector.

    `segments` holds keys, pos, x0, y0, x1, y1 (one row per segment) and a_max_x, b_min_x, xh per connector.
    The arc beyond a vertical counts the part of each segment on that side.
    """
    dx = F.col("x1") - F.col("x0")
    length = F.hypot(dx, F.col("y1") - F.col("y0"))

    lo, hi = F.least("x0", "x1"), F.greatest("x0", "x1")

    def share(at: Column, left: bool) -> Column:
        """Part of a segment strictly on one side of a vertical."""
        inside = F.least(F.greatest((at - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
        upright = F.when((lo < at) if left else (lo > at), 1.0).otherwise(0.0)
        return F.when(hi > lo, inside if left else 1 - inside).otherwise(upright)

    g = segments.groupBy(*keys).agg(
        F.sum(length).alias("_arc"),
        F.sum(F.when(dx < 0, length).otherwise(0.0)).alias("_back"),
        F.sum(length * share(F.col("a_max_x"), True)).alias("_left"),
        F.sum(length * share(F.col("b_min_x"), False)).alias("_right"),
        F.min_by(F.struct("x0", "y0"), "pos").alias("_p"),
        F.max_by(F.struct("x1", "y1"), "pos").alias("_q"),
        F.max("a_max_x").alias("_a"),
        F.max("b_min_x").alias("_b"),
        F.max("xh").alias("xh"),
    )
    xh = F.col("xh")
    return g.where((F.col("_arc") > 0) & (xh > 0)).select(
        *keys,
        (F.col("_arc") / xh).alias("arc"),
        (F.hypot(F.col("_q.x1") - F.col("_p.x0"), F.col("_q.y1") - F.col("_p.y0")) / xh).alias("chord"),
        ((F.col("_q.x1") - F.col("_p.x0")) / xh).alias("net_dx"),
        (F.col("_left") / xh).alias("seam_left"),
        (F.col("_right") / xh).alias("seam_right"),
        (F.col("_back") / F.col("_arc")).alias("backward"),
        F.greatest(F.lit(0.0), (F.col("_b") - F.col("_a")) / xh).alias("gap"),
    )


def connector_reason() -> Column:
    """First tripped connector signal; a stub under a quarter x-height is not rated."""
    rated = F.col("chord") >= 0.25
    return F.when(
        rated,
        first_reason(
            [
                ("seam_share", F.col("seam_left") + F.col("seam_right") > 1.3),
                ("backward_arc", F.col("net_dx") / F.col("arc") < 0.0),
                ("arc_vs_gap", F.col("arc") / (F.col("gap") + 2 * SEAM_BAND) > 2.0),
                ("straight_long", (F.col("arc") / F.col("chord") <= 1.02) & (F.col("arc") >= 1.0)),
            ]
        ),
    )


PROTOCOL_FIELDS = ("understanding", "reproduced", "stage", "resolution")


def transition_problem(stored: str = "s", change: str = "c") -> Column:
    """Why a change of a work item is refused; null when it may proceed.

    `stored` and `change` are struct columns. A field that is null in the change was not sent. Protocol fields travel
    only with the transition that demands them; closing needs an understanding that is already stored, a stage
    (not for notes) and a resolution; going back to open is always allowed when nothing else of the protocol is sent.
    """

    def blank(c: Column) -> Column:
        return c.isNull() | c.rlike(r"^\s*$")

    def after(field: str) -> Column:
        return F.coalesce(F.col(f"{change}.{field}"), F.col(f"{stored}.{field}"))

    target = F.col(f"{change}.status")
    closing = target.isin("done", "returned")
    demands = F.coalesce((target == "ack") | closing, F.lit(False))
    sent = F.lit(False)
    for f in PROTOCOL_FIELDS:
        sent = sent | F.col(f"{change}.{f}").isNotNull()
    note = F.coalesce(F.col(f"{stored}.kind") == "note", F.lit(False))
    return first_reason(
        [
            ("protocol_without_transition", ~demands & sent),
            ("not_understood", closing & blank(F.col(f"{stored}.understanding"))),
            ("ack_missing", (target == "ack") & (blank(after("understanding")) | blank(after("reproduced")))),
            ("close_missing", closing & (blank(after("resolution")) | (~note & blank(after("stage"))))),
        ]
    )


def payload_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Compare two long payload tables (keys, item, i, v): sides, lengths and the largest deviation per item."""
    left = a.select(*keys, "item", "i", F.col("v").alias("_a"), F.lit(1).alias("_in_a"))
    right = b.select(*keys, "item", "i", F.col("v").alias("_b"), F.lit(1).alias("_in_b"))
    j = left.join(right, [*keys, "item", "i"], "full_outer")
    g = j.groupBy(*keys, "item").agg(
        F.count("_in_a").alias("n_a"),
        F.count("_in_b").alias("n_b"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_dev"),
        F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("unmatched"),
    )
    return g.withColumn(
        "problem",
        first_reason(
            [
                ("missing_a", F.col("n_a") == 0),
                ("missing_b", F.col("n_b") == 0),
                ("length", F.col("unmatched") > 0),
                ("deviates", F.col("max_dev") > tolerance),
            ]
        ),
    ).drop("unmatched")


def inherit(override: Column, default: Column) -> Column:
    """The row's own value, else the inherited one."""
    return F.coalesce(override, default)


def uninherit(value: Column, default: Column) -> Column:
    """Null where a value only repeats what it would inherit."""
    return F.when(value.eqNullSafe(default), F.lit(None)).otherwise(value)


def identity_violations(rows: DataFrame, id_col: str, zero: Sequence[str], falsy: Sequence[str]) -> DataFrame:
    """Every way a self-comparison is not an exact identity: (id, problem, value)."""
    failed = rows.where(F.col("status") != "ok").select(
        id_col, F.concat(F.lit("status "), F.col("status")).alias("problem"), F.lit(None).cast("double").alias("value")
    )
    ok = rows.where(F.col("status") == "ok")
    items = [
        F.struct(F.lit(c).alias("problem"), F.col(c).cast("double").alias("value"), F.lit(True).alias("strict"))
        for c in zero
    ] + [
        F.struct(F.lit(c).alias("problem"), F.col(c).cast("double").alias("value"), F.lit(False).alias("strict"))
        for c in falsy
    ]
    long = ok.select(id_col, F.explode(F.array(*items)).alias("u")).select(id_col, "u.*")
    bad = F.when(F.col("strict"), ~F.coalesce(F.col("value") == 0.0, F.lit(False))).otherwise(
        F.coalesce(F.col("value") != 0.0, F.lit(False))
    )
    return failed.unionByName(long.where(bad).drop("strict"))


# fixed values: left bases of the transition classes
LOOP_EXIT_BASES = ["d", "longs"]
DECKSTRICH_BASES = ["o", "b", "v", "w", "r"]


def pair_class(left: Column) -> Column:
    """Transition class of a pair by its left key."""
    first = F.substring(left, 1, 1)
    return (
        F.when(left.isin(*LOOP_EXIT_BASES), "loop_exit")
        .when(left.isin(*DECKSTRICH_BASES), "deckstrich_arm")
        .when((first != F.lower(first)), "capital")
        .otherwise("arcade_diagonal")
    )
