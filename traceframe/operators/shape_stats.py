"""Robust per-group shape statistics over occurrence tables with nested point arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.functions.quantiles import exact_quantiles, median_and_mad
from traceframe.operators.resample import nested_segments, samples_on_segments

CONNECTOR_POINTS = 24
MIN_OCCURRENCES = 3
DERIVED_VARIANT = 100


def modal_value(df: DataFrame, keys: Sequence[str], value: str, seq: str) -> DataFrame:
    """Most common non-null value per key; ties go to the value seen first. Also says whether there were others."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first")
    )
    best = F.max_by(value, F.struct(F.col("_n"), -F.col("_first")))
    return counts.groupBy(*keys).agg(
        best.alias(value), F.max("_n").alias("n_modal"), (F.count(F.lit(1)) > 1).alias("several")
    )


def modal_shape(occ: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Occurrences with the modal array length of their group and whether they have it."""
    sized = occ.withColumn("n_points", F.size("anchors"))
    modal = modal_value(sized, keys, "n_points", seq).select(*keys, F.col("n_points").alias("modal_points"))
    return sized.join(modal, list(keys)).withColumn("kept", F.col("n_points") == F.col("modal_points"))


def points_long(occ: DataFrame, keep: Sequence[str], points: str = "anchors") -> DataFrame:
    """One row per array element."""
    return occ.select(*keep, F.posexplode(points).alias("i", "_p")).select(
        *keep, F.col("i").cast("bigint").alias("i"), F.col("_p.x").alias("x"), F.col("_p.y").alias("y")
    )


def element_median_mad(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median and MAD of both axes per (key, element). One long column carries both axes, so it is one pass."""
    axes = long.select(
        *keys,
        "i",
        F.explode(
            F.array(
                F.struct(F.lit("x").alias("a"), F.col("x").alias("v")),
                F.struct(F.lit("y").alias("a"), F.col("y").alias("v")),
            )
        ).alias("_u"),
    ).select(*keys, "i", F.col("_u.a").alias("_a"), F.col("_u.v").alias("_x"))
    both = median_and_mad(axes, [*keys, "i", "_a"], "_x", ("_med", "_mad"))

    def pick(axis: str, col: str, name: str) -> Column:
        return F.max(F.when(F.col("_a") == axis, F.col(col))).alias(name)

    return both.groupBy(*keys, "i").agg(
        pick("x", "_med", "med_x"), pick("y", "_med", "med_y"), pick("x", "_mad", "mad_x"), pick("y", "_mad", "mad_y")
    )


def gated_groups(occ: DataFrame, keys: Sequence[str], min_n: int) -> DataFrame:
    """Per group: kept rows, rows dropped for their shape, rows dropped because the group is too small."""
    shaped = modal_shape(occ, keys)
    counts = shaped.groupBy(*keys).agg(
        F.count_if("kept").alias("n_usable"), F.count_if(~F.col("kept")).alias("anchor_shape")
    )
    enough = F.col("n_usable") >= min_n
    return counts.select(
        *keys,
        F.when(enough, F.col("n_usable")).otherwise(0).alias("n_instances"),
        "anchor_shape",
        F.when(enough, 0).otherwise(F.col("n_usable")).cast("bigint").alias("below_min_n"),
    )


def pooled_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means, maxima and distinct counts; a statistic without any input stays null."""
    return rows.groupBy(*keys).agg(
        F.avg("geo_rmse_px").alias("geo_rmse_mean"),
        F.max("geo_rmse_px").alias("geo_rmse_max"),
        F.avg("xh_px").alias("xh_px_mean"),
        F.when(F.count("specimen_id") > 0, F.count_distinct("specimen_id")).alias("n_specimens"),
        F.count(F.lit(1)).alias("n_instances"),
    )


def histogram(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts per key and value, the long form of a histogram map."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- transitions


def transition_reason() -> Column:
    """First reason to drop a transition row: its own quality check, then its geometry."""
    usable = (F.size("connector") >= 2) & F.forall("connector", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    has_offset = F.col("offset.x").isNotNull() & F.col("offset.y").isNotNull()
    return F.when(~F.coalesce("fit_ok", F.lit(False)), "fit_bad").when(
        ~(F.coalesce(has_offset & usable, F.lit(False))), "geometry"
    )


def transition_points(rows: DataFrame, keys: Sequence[str], n: int = CONNECTOR_POINTS) -> DataFrame:
    """Usable transitions in long form: element -1 is the offset, 0..n-1 the resampled connector."""
    connector = samples_on_segments(nested_segments(rows, keys, "connector", n), keys)
    offset = rows.select(
        *keys, F.lit(-1).cast("bigint").alias("i"), F.col("offset.x").alias("x"), F.col("offset.y").alias("y")
    )
    return offset.unionByName(connector)


def transition_quality(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled quality of each transition; absent inputs stay null."""
    resid = F.when(F.col("a_resid").isNotNull() & F.col("b_resid").isNotNull(), F.greatest("a_resid", "b_resid"))
    return rows.groupBy(*keys).agg(
        F.avg("gen_chamfer").alias("gen_chamfer_mean"),
        F.max("gen_chamfer").alias("gen_chamfer_max"),
        F.avg("harvest_chamfer").alias("harvest_chamfer_mean"),
        F.max("harvest_chamfer").alias("harvest_chamfer_max"),
        F.avg(resid).alias("resid_mean"),
        F.max(resid).alias("resid_max"),
        F.avg(F.col("gap_ink").cast("double")).alias("gap_ink_share"),
        F.count_if(F.col("kind") == "pairs").alias("n_pairs"),
        F.count_if(F.col("kind") == "words").alias("n_words"),
        F.count_distinct(F.struct("kind", "specimen_id")).alias("n_specimens"),
        F.count(F.lit(1)).alias("n_instances"),
    )


# ------------------------------------------------------ deviation and promotion


def form_deviation(center: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean element distance of a median form from a stored one; null when the lengths differ or one is missing."""
    a = center.select(*keys, "i", F.col("med_x").alias("ax"), F.col("med_y").alias("ay"))
    b = stored.select(*keys, "i", F.col("x").alias("bx"), F.col("y").alias("by"))
    j = a.join(b, [*keys, "i"], "full_outer")
    both = F.col("ax").isNotNull() & F.col("bx").isNotNull()
    return j.groupBy(*keys).agg(
        F.when(F.count_if(~both) == 0, F.avg(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))).alias(
            "deviation"
        ),
        F.count("ax").alias("n_points"),
    )


def in_row_deviation(a: Column, b: Column) -> Column:
    """The same deviation for two nested forms on one row."""
    d = F.aggregate(
        F.zip_with(a, b, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])), F.lit(0.0), lambda s, v: s + v
    )
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), d / F.size(a))


def promote(
    aggregates: DataFrame,
    base: DataFrame,
    stored: DataFrame,
    selection: Sequence[str] | None = None,
    min_occurrences: int = MIN_OCCURRENCES,
) -> DataFrame:
    """Turn stored aggregates into derived forms, or say why not.

    aggregates(glyph_key, variant, center ARRAY<POINT>, n_instances), base(glyph_key, anchors, entry, exit, advance)
    and stored(glyph_key, anchors) hold one row per key. The first reason in a fixed order wins; an applied row
    carries the new anchors with entry, exit and advance moved by the shift of the nearest end element.
    """
    b = base.select(
        "glyph_key", F.col("anchors").alias("base_anchors"), "entry", "exit", "advance"
    )
    s = stored.select("glyph_key", F.col("anchors").alias("previous"))
    j = aggregates.join(b, "glyph_key", "left").join(s, "glyph_key", "left")
    excluded = F.lit(False) if selection is None else ~F.col("glyph_key").isin(list(selection))
    reason = (
        F.when(excluded, "excluded")
        .when(F.col("variant") == DERIVED_VARIANT, "derived_variant")
        .when(F.col("variant") != 0, "non_base_variant")
        .when(F.col("base_anchors").isNull(), "no_base")
        .when(F.coalesce(F.size("center"), F.lit(0)) != F.size("base_anchors"), "anchor_count")
        .when(F.col("n_instances") < min_occurrences, "below_min_occurrences")
    )
    j = j.withColumn("reason", reason)
    ok = F.col("reason").isNull()

    def end_shift(at: int, axis: str) -> Column:
        return F.element_at("center", at)[axis] - F.element_at("base_anchors", at)[axis]

    def moved(p: str, at: int) -> Column:
        return F.when(
            ok,
            F.struct((F.col(p)["x"] + end_shift(at, "x")).alias("x"), (F.col(p)["y"] + end_shift(at, "y")).alias("y")),
        )

    return j.select(
        "glyph_key",
        "variant",
        "n_instances",
        "reason",
        F.when(ok, F.col("center")).alias("anchors"),
        moved("entry", 1).alias("entry"),
        moved("exit", -1).alias("exit"),
        F.when(ok, F.col("advance") + end_shift(-1, "x")).alias("advance"),
        F.when(ok, F.col("previous").isNull()).alias("created"),
        F.when(ok, in_row_deviation(F.col("center"), F.col("previous"))).alias("deviation"),
    )


# --------------------------------------------------------------- pooled widths


def in_row_median(values: Column) -> Column:
    """Median of one in-row array; null when empty."""
    s = F.array_sort(values)
    n = F.size(values)
    lo = F.get(s, F.floor((n - 1) / 2).cast("int"))
    hi = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def pooled_nib(profiles: DataFrame, keys: Sequence[str], widths: str) -> DataFrame:
    """Mean over rows of each row's median width."""
    med = profiles.select(*keys, in_row_median(F.col(widths)).alias("_m")).where(F.col("_m").isNotNull())
    return med.groupBy(*keys).agg(F.avg("_m").alias("nib"), F.count(F.lit(1)).alias("n_profiles"))


def pen_calibration(profiles: DataFrame, keys: Sequence[str], widths: str) -> DataFrame:
    """Nearest-rank percentiles over all elements and the pen derived from them."""
    flat = profiles.select(*keys, F.explode(widths).alias("_w"))
    q = exact_quantiles(flat, keys, "_w", {"p10": (0.10, "half_up"), "p95": (0.95, "half_up")}, "n_values")
    width = F.greatest(F.lit(2.0) * F.col("p95"), F.lit(1e-3))
    return q.select(
        *keys,
        "n_values",
        F.col("p10").alias("hairline_half"),
        width.alias("nib_width"),
        F.least(F.greatest(F.lit(2.0) * F.col("p10") / width, F.lit(0.05)), F.lit(0.5)).alias("edge_fraction"),
    )


def noise_floor(rows: DataFrame, mads: DataFrame, pooled: DataFrame) -> DataFrame:
    """Spread reference per row: the key's own array when its length fits, else the pooled value, else none.

    rows(row_id, key, n_points), mads(key, mad ARRAY<DOUBLE>) one row per key, pooled(pooled) exactly one row.
    """
    j = rows.join(mads, "key", "left").join(F.broadcast(pooled.limit(1)), F.lit(True), "left")
    own = F.col("mad").isNotNull() & (F.size("mad") == F.col("n_points"))
    return j.select(
        "row_id",
        "key",
        "n_points",
        F.when(own, "aggregate").when(F.col("pooled").isNotNull(), "pooled").otherwise("none").alias("source"),
        F.when(own, F.aggregate("mad", F.lit(0.0), lambda a, b: a + b) / F.size("mad"))
        .otherwise(F.col("pooled"))
        .alias("mad_mean"),
    )


def best_row(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an explicit order. Spark limits each task to one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
