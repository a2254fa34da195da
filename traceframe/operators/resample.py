"""Arc-length resampling as a segment-to-target expansion: every segment emits the samples that fall on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions.ordered import neighbours, running_total


def samples_on_segments(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples of a polyline from its segments.

    Needs x0, y0, x1, y1, lo, hi (arc at both ends), total (arc of the polyline), n (samples wanted), is_first and
    is_last. Sample i sits at arc total * i / (n - 1); a sample belongs to the segment with lo <= arc < hi, the last
    sample to the last segment. Endpoints are exact. A polyline without length gives its first point for every
    sample but the last and its last point there.
    """
    step = F.col("total") / (F.col("n") - 1)
    flat = F.col("total") <= 0
    first = F.when(flat, F.lit(0)).otherwise(F.greatest(F.floor(F.col("lo") / step) - 1, F.lit(0)))
    last = F.when(flat, F.col("n") - 1).otherwise(F.least(F.ceil(F.col("hi") / step) + 1, F.col("n") - 1))
    emits = F.when(flat, F.col("is_first")).otherwise((F.col("hi") > F.col("lo")) | F.col("is_last"))
    spread = segments.where(emits).select("*", F.explode(F.sequence(first, last)).alias("i"))
    t = F.col("total") * F.col("i") / (F.col("n") - 1)
    on_last = F.col("is_last") & (F.col("i") == F.col("n") - 1)
    within = (t >= F.col("lo")) & (t < F.col("hi")) & (F.col("i") < F.col("n") - 1)
    f = F.when(F.col("hi") > F.col("lo"), (t - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)

    def at(a: str, b: str, end: str) -> Column:
        return (
            F.when(flat & (F.col("i") < F.col("n") - 1), F.col(a))
            .when(F.col("i") == F.col("n") - 1, F.col(end))
            .otherwise(F.col(a) + f * (F.col(b) - F.col(a)))
        )

    return spread.where(flat | within | on_last).select(
        *keys,
        F.col("i").cast("bigint").alias("i"),
        at("x0", "x1", "x_end").alias("x"),
        at("y0", "y1", "y_end").alias("y"),
    )


def nested_segments(rows: DataFrame, keys: Sequence[str], points: str, n: int) -> DataFrame:
    """Segments of a short nested polyline; arcs are summed inside the row."""
    p = F.col(points)

    def length(i: Column) -> Column:
        return F.hypot(F.get(p, i)["x"] - F.get(p, i - 1)["x"], F.get(p, i)["y"] - F.get(p, i - 1)["y"])

    arcs = F.aggregate(
        F.sequence(F.lit(1), F.size(p) - 1),
        F.array(F.lit(0.0)),
        lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + length(i))),
    )
    spread = rows.select(*keys, points, arcs.alias("_arc")).select(
        *keys, points, "_arc", F.explode(F.sequence(F.lit(0), F.size(p) - 2)).alias("_k")
    )
    k = F.col("_k")
    return spread.select(
        *keys,
        F.get(p, k)["x"].alias("x0"),
        F.get(p, k)["y"].alias("y0"),
        F.get(p, k + 1)["x"].alias("x1"),
        F.get(p, k + 1)["y"].alias("y1"),
        F.element_at(p, -1)["x"].alias("x_end"),
        F.element_at(p, -1)["y"].alias("y_end"),
        F.get("_arc", k).alias("lo"),
        F.get("_arc", k + 1).alias("hi"),
        F.element_at("_arc", -1).alias("total"),
        F.lit(n).cast("bigint").alias("n"),
        (k == 0).alias("is_first"),
        (k == F.size(p) - 2).alias("is_last"),
    )


def with_arc(trace: DataFrame, keys: Sequence[str], pos: str = "pos", name: str = "arc") -> DataFrame:
    """Cumulative arc length along a stroke; the first point is at 0."""
    stepped = neighbours(trace, keys, pos, {"_px": ("x", -1), "_py": ("y", -1)})
    step = F.coalesce(F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py")), F.lit(0.0))
    return running_total(stepped.withColumn("step", step).drop("_px", "_py"), keys, pos, {name: "step"})


def long_segments(trace: DataFrame, keys: Sequence[str], n: Column, pos: str = "pos") -> DataFrame:
    """Segments of long-form strokes; `n` is an expression over `total` and `n_points`."""
    arced = with_arc(trace, keys, pos, "hi")
    ends = arced.groupBy(*keys).agg(
        F.max("hi").alias("total"),
        F.count(F.lit(1)).alias("n_points"),
        F.max_by(F.struct("x", "y"), pos).alias("_end"),
    )
    back = neighbours(arced, keys, pos, {"x0": ("x", -1), "y0": ("y", -1), "lo": ("hi", -1)})
    j = back.join(ends, list(keys))
    single = F.col("n_points") == 1
    j = j.where((F.col(pos) > 0) | single)
    return j.select(
        *keys,
        F.coalesce("x0", "x").alias("x0"),
        F.coalesce("y0", "y").alias("y0"),
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.col("_end.x").alias("x_end"),
        F.col("_end.y").alias("y_end"),
        F.coalesce("lo", F.lit(0.0)).alias("lo"),
        "hi",
        "total",
        n.cast("bigint").alias("n"),
        (single | (F.col(pos) == 1)).alias("is_first"),
        (F.col(pos) == F.col("n_points") - 1).alias("is_last"),
    )


def resample_by_step(trace: DataFrame, keys: Sequence[str], step: float) -> DataFrame:
    """Strokes resampled to max(2, round(arc / step) + 1) samples; a stroke without length gives its endpoints."""
    n = F.when(F.col("total") > 0, F.greatest(F.lit(2), F.bround(F.col("total") / step) + 1)).otherwise(2)
    return samples_on_segments(long_segments(trace, keys, n), keys)


def resample_to(trace: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Strokes resampled to exactly `n` samples."""
    return samples_on_segments(long_segments(trace, keys, F.lit(n)), keys)
