"""Order-dependent matching and alignment against naive twins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceframe.operators import compare as C
from traceframe.operators import matching as M


def points(spark, name, rows):
    return spark.createDataFrame(rows, f"case_id BIGINT, {name} BIGINT, x DOUBLE, y DOUBLE")


@pytest.fixture(scope="module")
def clouds(spark):
    rng = random.Random(3)
    ref = [(c, i, rng.random() * 3, rng.random() * 3) for c in range(4) for i in range(25)]
    cand = [(c, i, rng.random() * 3, rng.random() * 3) for c in range(4) for i in range(22)]
    return ref, cand, points(spark, "ref", ref), points(spark, "cand", cand)


@pytest.mark.parametrize("limit", [M.ROWS_IN_TASK, 7])
def test_one_to_one(clouds, limit):
    ref, cand, r, c = clouds
    want = set()
    for case in range(4):
        free_r, free_c = {p[1]: p for p in ref if p[0] == case}, {p[1]: p for p in cand if p[0] == case}
        pairs = sorted((math.hypot(a[2] - b[2], a[3] - b[3]), i, j) for i, a in free_r.items() for j, b in free_c.items())
        used_r, used_c = set(), set()
        for d, i, j in pairs:
            if d <= 0.55 and i not in used_r and j not in used_c:
                used_r.add(i), used_c.add(j), want.add((case, i, j))
    got = {(x["case_id"], x["ref"], x["cand"]) for x in M.greedy_one_to_one(r, c, ["case_id"], 0.55, limit).collect()}
    assert got == want


@pytest.mark.parametrize(("margin", "limit"), [(0.0, 9), (0.1, 9), (0.1, M.ROWS_IN_TASK)])
def test_sequential(clouds, margin, limit):
    ref, cand, r, c = clouds
    want = {}
    for case in range(4):
        free = {p[1]: p for p in cand if p[0] == case}
        for p in [p for p in ref if p[0] == case]:
            near = sorted((math.hypot(p[2] - q[2], p[3] - q[3]), j) for j, q in free.items())
            if not near or near[0][0] > 0.6:
                want[case, p[1]] = ("no_candidate", None)
            elif len(near) > 1 and near[1][0] - near[0][0] < margin:
                want[case, p[1]] = ("ambiguous", None)
            else:
                want[case, p[1]] = ("ok", near[0][1])
                del free[near[0][1]]
    got = {(x["case_id"], x["ref"]): (x["reason"], x["cand"]) for x in M.sequential_matches(r, c, ["case_id"], 0.6, margin, limit).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [M.ROWS_IN_TASK, 11])
def test_suppression(clouds, limit):
    ref, _, r, _ = clouds
    r = r.withColumn("id", F.struct("ref", F.lit("a")))  # an id of any type
    want = set()
    for case in range(4):
        kept = []
        for p in sorted((p for p in ref if p[0] == case), key=lambda p: (-p[2], p[1])):
            if all(math.hypot(p[2] - q[2], p[3] - q[3]) > 0.5 for q in kept):
                kept.append(p)
        want |= {(case, p[1]) for p in kept}
    got = M.suppressed(r, ["case_id"], "id", [-F.col("x"), F.col("ref")], 0.5, limit)
    assert {(x["case_id"], x["ref"]) for x in got.collect()} == want


def test_chain_in_chunks(spark):
    """Every decision of a falling chain hangs on the one before it."""
    n, at, gap = 2500, 0.0, 0.5
    ref, cand = [], []
    for i in range(n):
        ref.append((1, i, at, 0.0))
        at += gap
        cand.append((1, i, at, 0.0))
        at += gap * 0.9999
        gap *= 0.9998
    got = {(x["ref"], x["cand"]) for x in M.greedy_one_to_one(points(spark, "ref", ref), points(spark, "cand", cand), ["case_id"], 0.6, 1200).collect()}
    pairs = sorted((abs(a[2] - b[2]), a[1], b[1]) for i, a in enumerate(ref) for b in cand[max(0, i - 4) : i + 4] if abs(a[2] - b[2]) <= 0.6)
    used_r, used_c, want = set(), set(), set()
    for _, i, j in pairs:
        if i not in used_r and j not in used_c:
            used_r.add(i), used_c.add(j), want.add((i, j))
    assert got == want


def test_nearest_far_away(spark):
    a = points(spark, "i", [(1, 0, 0.0, 0.0), (1, 1, 5.0, 5.0)])
    b = points(spark, "j", [(1, 7, 100.0, 0.0), (1, 8, 5.0, 6.0)])
    got = {r["i"]: (r["j"], r["dist"]) for r in M.nearest_distances(a, b, ["case_id"], 0.5, "j").collect()}
    assert got[1] == (8, 1.0)
    assert got[0][0] == 8 and got[0][1] == pytest.approx(math.hypot(5, 6))


def naive_dtw(a, b):
    n, m = len(a), len(b)
    d = [[math.dist(p, q) for q in b] for p in a]
    cost = [[math.inf] * m for _ in range(n)]
    for i in range(n):
        for j in range(m):
            prev = [0.0] if i == j == 0 else []
            if i:
                prev.append(cost[i - 1][j])
            if j:
                prev.append(cost[i][j - 1])
            if i and j:
                prev.append(cost[i - 1][j - 1])
            cost[i][j] = d[i][j] + min(prev)
    return cost[-1][-1]


def test_alignment_cost_and_path():
    rng = random.Random(5)
    for n, m in ((1, 1), (1, 6), (7, 1), (5, 9), (30, 17)):
        a = np.array([(rng.random(), rng.random()) for _ in range(n)])
        b = np.array([(rng.random(), rng.random()) for _ in range(m)])
        pa, pb, cost = C.alignment_path(a, b)
        assert cost == pytest.approx(naive_dtw(a, b))
        assert (pa[0], pb[0], pa[-1], pb[-1]) == (0, 0, n - 1, m - 1)
        steps = set(zip(np.diff(pa).tolist(), np.diff(pb).tolist(), strict=True))
        assert steps <= {(0, 1), (1, 0), (1, 1)}
        assert sum(math.dist(a[i], b[j]) for i, j in zip(pa, pb, strict=True)) == pytest.approx(cost)


def test_tiles_equal_one_task(spark):
    """Sequences of several tiles, also on a grid where many ways cost the same."""
    rng = random.Random(6)
    rows = []
    for case, (n, m) in enumerate([(23, 40), (40, 17), (8, 8), (30, 3), (1, 19), (26, 26)]):
        for side, k in (("r", n), ("c", m)):
            put = (lambda: float(rng.randrange(3))) if case % 2 else rng.random
            rows += [(case, side, i, put(), put()) for i in range(k)]
    df = spark.createDataFrame(rows, "case_id BIGINT, side STRING, i BIGINT, x DOUBLE, y DOUBLE")
    ref, cand = (df.where(F.col("side") == s).drop("side") for s in ("r", "c"))
    far = lambda f: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(5, 7).collect())
    one = lambda f: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(1000, 7).collect())
    for f in (lambda limit, tile: C.alignment_pairs(ref, cand, ["case_id"], limit, tile), lambda limit, tile: C.dtw(ref, cand, ["case_id"], limit, tile)):
        assert far(f) == one(f)


def trace(spark, strokes, case=1):
    rows = [(case, s, i, float(x), float(y)) for s, pts in enumerate(strokes) for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "case_id BIGINT, stroke BIGINT, pos BIGINT, x DOUBLE, y DOUBLE")


def test_eight_has_one_crossing_and_out_and_back_one_zone(spark):
    step = 0.02
    eight = [(math.sin(2 * t), math.sin(t)) for t in np.linspace(-0.5, 2 * math.pi - 0.6, 200)]
    back = [(0.0, 0.0), (0.0, 1.0), (0.02, 1.0), (0.02, 0.0)]
    cross = [[(0, 0), (1, 1)], [(0, 1), (1, 0)]]
    t = trace(spark, [eight], 1).unionByName(trace(spark, [back], 2)).unionByName(trace(spark, cross, 3))
    got = {r["case_id"]: r for r in C.trace_counters(C.sampled(t, step), step).collect()}
    assert got[1]["crossings"] == 1
    assert (got[2]["crossings"], got[2]["retrace"]) == (0, 1)
    assert got[3]["crossings"] == 1


def test_components_of_a_long_path(spark):
    n = 200
    nodes = spark.range(n + 5).withColumnRenamed("id", "id")
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = dict((r["id"], r["component"]) for r in M.connected_components(nodes, edges).collect())
    assert all(got[i] == 0 for i in range(n)) and all(got[i] == i for i in range(n, n + 5))
