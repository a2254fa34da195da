"""Masks decided in one task against the spread form of the same operator."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from traceframe.operators import compare as C
from traceframe.operators import geometry as G
from traceframe.sources import readers as Rd


def pixels(spark, seed: int, masks: int = 4, size: int = 64):
    rng = random.Random(seed)
    rows = {(m, rng.randrange(size), rng.randrange(size)) for m in range(masks) for _ in range(40 + 60 * m)}
    return spark.createDataFrame(sorted(rows), "mask_id BIGINT, x INT, y INT")


@pytest.mark.parametrize("size", [64, 100_000])
def test_slant_in_a_task_and_spread(spark, size):
    p = pixels(spark, 1, size=size)
    one, spread = (sorted(map(tuple, G.slant(p, ["mask_id"], in_task=n).collect())) for n in (1 << 16, 0))
    assert one == spread and len(one) == 4


def test_slant_does_not_multiply_pixels_of_small_masks(spark):
    """Rows leaving the job for small masks are one a mask: no generator runs over their pixels."""
    plan = G.slant(pixels(spark, 2), ["mask_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def both_ways(run):
    """Rows with masks in one task, with all of them spread, and with some of each."""
    return [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in run(n).collect())) for n in (1 << 14, 0, 150)]


def test_adaptive_iou_in_a_task_and_in_rounds(spark):
    """Masks of one side only, and pixels beside the grid."""
    ink = pixels(spark, 3, masks=3, size=24).where("mask_id <> 1")
    cand = pixels(spark, 4, masks=3, size=27).where("mask_id <> 2").withColumn("x", F.col("x") - 2)
    one, rounds, some = both_ways(lambda n: C.adaptive_iou(cand, ink, ["mask_id"], 24, 24, n))
    assert one == rounds == some and len(one) == 3

def test_registration_in_a_task_and_spread(spark):
    ink = pixels(spark, 5, masks=3, size=24)
    pts = pixels(spark, 6, masks=4, size=24).select("mask_id", (F.col("x") + 0.25).alias("x"), (F.col("y") - 3.0).alias("y"))

    def run(n):
        return C.registration(pts, C.grid_distances(ink, ["mask_id"], 24, 24, n), ["mask_id"], 10.0, 24, 24, n)

    one, spread, some = both_ways(run)
    assert one == spread == some and len(one) == 3
    near = lambda n: C.grid_distances(ink, ["mask_id"], 24, 24, n)
    assert len(set(map(str, both_ways(near)))) == 1


def test_adaptive_ink_by_tiles_is_that_of_two_passes(spark):
    """Lines shorter than the kernel's reach of 33, tiles smaller and larger than the grid, one exchange of the cells."""
    for width, height in ((90, 40), (30, 70)):
        cells = spark.range(width * height).select(
            F.lit(7).cast("bigint").alias("mask_id"), (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"),
            (F.pmod(F.hash("id"), F.lit(50)) / 50).alias("grey"), F.lit(width).alias("width"), F.lit(height).alias("height"),
        )
        kernel = Rd.gaussian_kernel((Rd.BLOCK - 1) / 6.0)
        rows = Rd.weighted_pass(cells.withColumn("local", F.col("grey")), ["mask_id", "y"], "x", "width", "local", kernel)
        both = Rd.weighted_pass(rows, ["mask_id", "x"], "y", "height", "local", kernel).where(F.col("grey") < F.col("local") - Rd.OFFSET)
        want = sorted((r["x"], r["y"], round(r["local"], 9)) for r in both.collect())
        for tile in (16, 256):
            ink = Rd.adaptive_ink(cells, tile=tile)
            assert ink._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
            assert sorted((r["x"], r["y"], round(r["local"], 9)) for r in ink.collect()) == want
