"""Runs and bands along a position: near-vertical straight runs, merged events, row bands; displacement near a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions.ordered import dense_position
from traceframe.functions.quantiles import exact_quantiles
from traceframe.operators import geometry as G
from traceframe.operators.resample import with_arc

# A run is vertical within so many degrees, so long and so straight (x-heights, bow over chord).
VERTICAL_DEG, VERTICAL_ARC, VERTICAL_BOW, LEAST_SAMPLES = 15.0, 0.45, 0.035, 4
# Flagged samples up to so many apart are one event, which has to be so long (x-heights).
EVENT_REACH, EVENT_ARC = 3, 0.25
# Rows of ink are smoothed over 9 pixels and count from 30 % of the 99th percentile; gaps below 14 close, bands below 22 go.
ROW_SMOOTH, CORE_SHARE, BAND_GAP, BAND_HEIGHT = 9, 0.30, 14, 22
#: Fixed value: arc of an element that counts as its join (x-heights).
STUB_ARC = 0.4


def vertical_runs(trace: DataFrame, unit: float = 1.0, angle: float = VERTICAL_DEG, arc: float = VERTICAL_ARC, bow: float = VERTICAL_BOW) -> DataFrame:
    """Longest runs of samples whose tangent is within `angle` of the vertical, long and straight enough.

    (case_id, stroke, start, end, arc, bow); bow is the largest distance from the chord over the chord. Strokes of fewer than
    four points have none; where the pen stands, the tangent counts as vertical.
    """
    keys = G.STROKE
    size = trace.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST_SAMPLES).drop("_n")
    t = G.tangents(with_arc(trace.join(size, keys, "left_semi"), keys))
    t = t.withColumn("hot", F.degrees(F.atan2(F.abs("tx"), F.abs("ty"))) <= angle)
    runs = G.islands(t.select(*keys, "pos", "hot"), keys, "pos", "hot")
    ends = runs.withColumn("pos", F.explode(F.array("start", "end"))).join(t.select(*keys, "pos", "arc"), [*keys, "pos"])
    long = ends.groupBy(*keys, "start", "end").agg((F.max("arc") - F.min("arc")).alias("arc")).where(F.col("arc") >= arc * unit)
    inside = long.withColumn("pos", F.explode(F.sequence("start", "end"))).join(t.select(*keys, "pos", "x", "y"), [*keys, "pos"])
    straight = G.straightness(inside, [*keys, "start"]).where(F.col("bow") <= bow)
    return long.join(straight, [*keys, "start"]).select(*keys, "start", "end", "arc", "bow")


def merged_events(rows: DataFrame, keys: Sequence[str], pos: str, flag: str, step: float, reach: int = EVENT_REACH, arc: float = EVENT_ARC) -> DataFrame:
    """Flagged samples at most `reach` apart as one event of at least `arc`, at `step` a sample: (keys, start, end, n, arc)."""
    e = G.islands(rows, keys, pos, flag, 1, reach - 1)
    return e.withColumn("arc", (F.col("end") - F.col("start")) * step).where(F.col("arc") >= arc)


def row_bands(rows: DataFrame, keys: Sequence[str], gap: int = BAND_GAP, height: int = BAND_HEIGHT, expected: int | None = None) -> DataFrame:
    """Bands of dense rows from top to bottom: (keys, band, y0, y1), y1 exclusive, the first `expected` of them.

    rows(keys, y, n) hold every row of a page. A row is dense from a share of the 99th percentile of the smoothed rows with ink;
    a page without ink has no band.
    """
    s = G.box_smoothed(rows, keys, "y", "n", ROW_SMOOTH, "smooth")
    top = exact_quantiles(s.where("smooth > 0"), keys, "smooth", {"_top": 0.99})
    s = s.join(top, list(keys)).withColumn("dense", F.col("smooth") >= CORE_SHARE * F.col("_top"))
    e = G.islands(s, keys, "y", "dense", 1, gap - 1)
    bands = e.select(*keys, F.col("start").alias("y0"), (F.col("end") + 1).alias("y1")).where(F.col("y1") - F.col("y0") >= height)
    numbered = dense_position(bands, keys, ["y0"], F.floor(F.col("y0") / (1 << 16)), "band")
    return numbered if expected is None else numbered.where(F.col("band") < expected)


def displacement_at_join(rows: DataFrame, keys: Sequence[str], delta: Column, from_end: Column, stub: float = STUB_ARC) -> DataFrame:
    """Mean displacement of an element near its join and elsewhere, after the median shift of the element is taken away.

    rows(keys, stroke, joined, pos, x, y): `joined` marks the stroke that holds the join; its samples within `stub` of arc of the
    join (at its end where `from_end`) are near. Gives (keys, near, n_near, rest, n_rest); a side without samples is 0.
    """
    stroke = [*keys, "stroke"]
    arced = with_arc(rows.withColumn("_d", delta).withColumn("_back", from_end), stroke)
    total = arced.groupBy(*stroke).agg(F.max("arc").alias("_total"))
    med = exact_quantiles(arced, keys, "_d", {"_m": 0.5})
    j = arced.join(total, stroke).join(med, list(keys))
    away = F.when(F.col("_back"), F.col("_total") - F.col("arc")).otherwise(F.col("arc"))
    j = j.withColumn("_near", F.col("joined") & (away <= stub)).withColumn("_dev", F.abs(F.col("_d") - F.col("_m")))
    side = lambda near: F.coalesce(F.avg(F.when(near, F.col("_dev"))), F.lit(0.0))
    return j.groupBy(*keys).agg(
        side(F.col("_near")).alias("near"), F.count_if("_near").alias("n_near"), side(~F.col("_near")).alias("rest"), F.count_if(~F.col("_near")).alias("n_rest")
    )
