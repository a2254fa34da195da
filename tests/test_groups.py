"""Many small groups decided together against the plain form of the same operator."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceframe.operators import compare as C
from traceframe.operators import matching as M
from traceframe.operators.groups import solved_groups


def clouds(spark, name: str, seed: int, cases: int = 40):
    rng = random.Random(seed)
    rows = [(c, i, rng.random() * 3, rng.random() * 3) for c in range(cases) for i in range(1 + (c * seed) % 17)]
    return rows, spark.createDataFrame(rows, f"case_id BIGINT, {name} BIGINT, x DOUBLE, y DOUBLE")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("back", [False, True])
def test_paths_of_many_cases(monkeypatch, back):
    """The same paths and costs, to the last bit, as case by case; the longest case is too long to be filled with others."""
    monkeypatch.setattr(C, "CELLS_AT_ONCE", 3000)
    rng = np.random.default_rng(4)
    n, m = rng.integers(1, 30, 60), rng.integers(1, 30, 60)
    n[7] = m[7] = 60
    first = np.cumsum(n + m) - n - m
    xy = np.round(rng.random((int((n + m).sum()), 2)) * 4) / 4  # with ties
    case, i, j, cost = C.alignment_paths(xy, first, n, m, back)
    for k in range(60):
        a, b = np.split(xy[first[k] : first[k] + n[k] + m[k]], [n[k]])
        want = C.alignment_path(a, b[::-1] if back else b)
        assert (want[0] == i[case == k]).all() and (want[1] == j[case == k]).all() and want[2] == cost[k]


def test_alignment_has_no_call_for_each_case(spark):
    (_, a), (_, b) = clouds(spark, "i", 3), clouds(spark, "i", 5)
    for df in (C.dtw(a, b, ["case_id"]), C.alignment_pairs(a, b, ["case_id"])):
        assert "MapInArrow" in plan(df) and "CoGroups" not in plan(df)


def test_alignment_leaves_out_cases_of_one_side(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0)], "case_id BIGINT, i BIGINT, x DOUBLE, y DOUBLE")
    one, two = a.where("case_id = 1"), a.where("case_id = 2")
    assert C.dtw(one, two, ["case_id"]).collect() == [] and C.alignment_pairs(one, two, ["case_id"]).collect() == []


@pytest.mark.parametrize("at_once", [1, 7, 1 << 16])
def test_groups_come_whole(spark, at_once):
    rows = spark.createDataFrame([(k % 5 or None, k) for k in range(300)], "g INT, v BIGINT")

    def solve(table, first):
        ends = np.append(first[1:], table.num_rows)
        values = table["v"].to_numpy()
        import pyarrow as pa

        return first, {"n": pa.array(ends - first), "low": pa.array([int(values[a]) for a in first])}

    got = {tuple(r) for r in solved_groups(rows, ["g"], ["v"], solve, "n bigint, low bigint", at_once).collect()}
    assert got == {(k or None, 60, k) for k in range(5)}


def test_decisions_have_no_call_for_each_case(spark, monkeypatch):
    (_, a), (_, b) = clouds(spark, "ref", 3), clouds(spark, "cand", 5)
    seen = []
    keep = M.checkpointed
    monkeypatch.setattr(M, "checkpointed", lambda df: seen.append(plan(df)) or keep(df))
    M.greedy_one_to_one(a, b, ["case_id"], 0.5).collect()
    M.sequential_matches(a, b, ["case_id"], 0.5, 0.1).collect()
    assert any("MapInArrow" in p for p in seen) and not any("FlatMapGroups" in p for p in seen)


@pytest.mark.parametrize("owner", [None, "cand"])
def test_nearest_in_a_task_and_on_the_grid(spark, monkeypatch, owner):
    monkeypatch.setattr(M, "PAIRS_AT_ONCE", 50)
    (ref, a), (cand, b) = clouds(spark, "ref", 3), clouds(spark, "cand", 5)
    b = b.where("case_id <> 11").unionByName(b.where("case_id = 12").withColumn("cand", F.col("cand") + 100))  # ties
    one, grid, some = (
        sorted(tuple(r) for r in M.nearest_distances(a, b, ["case_id"], 0.2, owner, in_task=n).collect()) for n in (M.ROWS_OF_KEY, 0, 15)
    )
    want = sorted((c, i, min(math.hypot(x - q[2], y - q[3]) for q in cand if q[0] == c)) for c, i, x, y in ref if c != 11)
    for got in (one, grid, some):
        assert [r[:2] for r in got] == [w[:2] for w in want]
        assert [r[4] for r in got] == pytest.approx([w[2] for w in want], abs=1e-12)
    assert [r[5:] for r in one] == [r[5:] for r in grid] == [r[5:] for r in some]


def test_nearest_does_not_multiply_points_of_small_keys(spark):
    (_, a), (_, b) = clouds(spark, "ref", 3), clouds(spark, "cand", 5)
    assert "Generate" not in plan(M.nearest_distances(a, b, ["case_id"], 0.2))


def test_grid_of_crowded_cells_begins_small(spark, monkeypatch):
    """The first round's pairs follow the points, not the square of the points in a cell."""
    rng = random.Random(8)
    rows = [(1, i, rng.random(), rng.random()) for i in range(600)]
    a = spark.createDataFrame(rows, "case_id BIGINT, i BIGINT, x DOUBLE, y DOUBLE")
    sizes = []
    keep = M.near_pairs
    monkeypatch.setattr(M, "near_pairs", lambda *x: sizes.append(x[3]) or keep(*x))
    b = a.select("case_id", (F.col("x") + 0.001).alias("x"), "y")
    got = M.nearest_distances(a, b, ["case_id"], 1.0, in_task=0).collect()
    assert sizes[0] < 0.2 and len(got) == 600
    for r in got[:50]:
        assert r["dist"] == pytest.approx(min(math.hypot(r["x"] - p[2] - 0.001, r["y"] - p[3]) for p in rows), abs=1e-12)
