"""Nearest segments against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from traceframe.operators import matching as M


@pytest.mark.parametrize("in_task", [0, 60, 1 << 12])
def test_nearest_segments_in_a_task_and_on_the_grid(spark, in_task):
    rng = random.Random(5)
    place = lambda: round(rng.uniform(-6, 6), 2)
    points = [(k, n, place(), place()) for k in (1, 2, 3) for n in range(20 * k)]
    segs = [(k, n, x, y, *((x, y) if n % 7 == 0 else (place(), place()))) for k in (2, 3, 4) for n in range(15 * k) for x, y in [(place(), place())]]
    segs += [(2, 700, *segs[1][2:])]  # a tie goes to the smaller owner
    p = spark.createDataFrame(points, "k INT, n INT, x DOUBLE, y DOUBLE")
    s = spark.createDataFrame(segs, "k INT, owner INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")

    def gap(x, y, x0, y0, x1, y1):
        square = (x1 - x0) ** 2 + (y1 - y0) ** 2
        t = min(1.0, max(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / square)) if square else 0.0
        return round(math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)), 9)

    want = sorted((k, n, *min((gap(x, y, *g[2:]), g[1]) for g in segs if g[0] == k)) for k, n, x, y in points if k > 1)
    got = M.nearest_segments(p, s, ["k"], 0.5, in_task).withColumn("dist", F.round("dist", 9))
    assert sorted((r["k"], r["n"], r["dist"], r["owner"]) for r in got.collect()) == want
