"""Straight runs, bands, segment distances, join displacement and the table function on made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from traceframe.functions.udtf import register_resample
from traceframe.operators import matching as M
from traceframe.operators import resample as Rs
from traceframe.operators import straight as T

SCHEMA = "case_id BIGINT, stroke BIGINT, pos BIGINT, x DOUBLE, y DOUBLE"


def trace(spark, strokes):
    return spark.createDataFrame([(1, s, i, float(x), float(y)) for s, pts in enumerate(strokes) for i, (x, y) in enumerate(pts)], SCHEMA)


def test_vertical_runs(spark):
    down = [(0.0, y / 10) for y in range(11)]
    slanted = [(y / 10 * math.tan(math.radians(20)), y / 10) for y in range(11)]
    bowed = [(0.5 * math.sin(y / 10 * math.pi) * 0.2, y / 10) for y in range(11)]
    short = [(0.0, y / 10) for y in range(5)]
    hook = [(0.0, y / 10) for y in range(8)] + [(0.2, 0.75), (0.4, 0.75)]
    got = {r["stroke"]: (r["start"], r["end"]) for r in T.vertical_runs(trace(spark, [down, slanted, bowed, short, hook, down[:3]])).collect()}
    assert got == {0: (0, 10), 4: (0, 6)}


def test_events_close_short_gaps(spark):
    hot = [1, 2, 5, 6, 10, 11, 12, 20]
    rows = spark.createDataFrame([(1, i, i in hot) for i in range(25)], "case_id BIGINT, pos BIGINT, hot BOOLEAN")
    got = {(r["start"], r["end"], r["n"]) for r in T.merged_events(rows, ["case_id"], "pos", "hot", 0.1).collect()}
    assert got == {(1, 6, 4)}  # 10 to 12 is too short, 20 alone has no length


def test_row_bands(spark):
    dense = [*range(20, 60), *range(66, 90), *range(150, 155), *range(200, 240)]
    rows = spark.createDataFrame([(1, y, 50 if y in dense else 0) for y in range(300)] + [(2, y, 0) for y in range(9)], "page BIGINT, y BIGINT, n BIGINT")
    got = [(r["page"], r["band"], r["y0"], r["y1"]) for r in T.row_bands(rows, ["page"]).orderBy("band").collect()]
    assert [g[1] for g in got] == [0, 1] and all(g[0] == 1 for g in got)
    assert got[0][2] < 22 and got[0][3] > 88 and abs(got[1][2] - 199) < 3
    assert T.row_bands(rows, ["page"], expected=1).count() == 1


def test_segment_distances(spark):
    rng = random.Random(9)
    points = [(c, i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for c in (1, 2) for i in range(60)] + [(1, 99, 90.0, -40.0), (3, 1, 0.0, 0.0)]
    segs = [(c, i, *(rng.uniform(-5, 5) for _ in range(4))) for c in (1, 2) for i in range(12)]
    segs += [(1, 50, 1.0, 1.0, 1.0, 1.0), (2, 51, 0.0, -9.0, 0.0, 9.0), (2, 52, -9.0, 2.0, 9.0, 2.0), (1, 53, 4.0, 4.0, 4.0, 4.0), (1, 54, 4.0, 4.0, 4.0, 4.0)]
    p = spark.createDataFrame(points, "case_id BIGINT, i BIGINT, x DOUBLE, y DOUBLE")
    s = spark.createDataFrame(segs, "case_id BIGINT, owner BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")

    def away(x, y, x0, y0, x1, y1):
        l2 = (x1 - x0) ** 2 + (y1 - y0) ** 2
        t = max(0.0, min(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / l2)) if l2 else 0.0
        return math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0))

    got = {(r["case_id"], r["i"]): (r["dist"], r["owner"]) for r in M.nearest_segments(p, s, ["case_id"], 0.4).collect()}
    assert len(got) == len(points) - 1  # the third case has no segment
    for c, i, x, y in points[:-1]:
        best = min((away(x, y, *q[2:]), q[1]) for q in segs if q[0] == c)
        assert got[c, i][0] == pytest.approx(best[0]) and got[c, i][1] == best[1]


def test_displacement_near_a_join(spark):
    rows = [(1, 0, False, i, i * 0.1, 0.0, 1.0) for i in range(10)] + [(1, 1, True, i, i * 0.1, 1.0, 1.5 if i > 6 else 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "case_id BIGINT, stroke BIGINT, joined BOOLEAN, pos BIGINT, x DOUBLE, y DOUBLE, d DOUBLE")
    (r,) = T.displacement_at_join(df, ["case_id"], F.col("d"), F.lit(True), 0.25).collect()
    assert (r["near"], r["n_near"], r["rest"], r["n_rest"]) == (0.5, 3, 0.0, 17)
    (r,) = T.displacement_at_join(df, ["case_id"], F.col("d"), F.lit(False), 0.25).collect()
    assert r["near"] == 0.0 and r["n_near"] == 3 and r["rest"] == pytest.approx(1.5 / 17)


def test_table_function_equals_native(spark):
    t = trace(spark, [[(0, 0), (1, 0), (1, 2)], [(3, 3)], [(1, 1), (1, 1)], [(0, 0), (0, 0), (0.3, 0.4)]])
    register_resample(spark, "resample_for_test")
    got = spark.sql("SELECT * FROM resample_for_test(TABLE(SELECT * FROM {t}) PARTITION BY (case_id, stroke) ORDER BY (pos), 0.3D)", t=t).collect()
    want = Rs.resample_by_step(t, ["case_id", "stroke"], 0.3).collect()
    show = lambda rows: sorted((r["case_id"], r["stroke"], r["i"], round(r["x"], 9), round(r["y"], 9)) for r in rows)
    assert show(got) == show(want)
