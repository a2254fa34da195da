"""Near pairs against all pairs, in a task and on the grid."""

from __future__ import annotations

import math
import random

import pytest

from traceframe.operators import matching as M


def _points(spark, seed, keys):
    rng = random.Random(seed)
    rows = [(k, n, round(rng.uniform(-3, 3), 1), round(rng.uniform(-3, 3), 1), f"p{n}") for k in keys for n in range(12 * (k or 1))]
    odd = [(1, 900, None, 0.0, None), (1, 901, float("nan"), 0.0, "nan"), (2, 902, float("inf"), 0.0, "inf"), (2, 903, float("inf"), 0.0, "inf"), (3, 904, 1e12, 1e12, "far")]
    rows += odd
    return rows, spark.createDataFrame(rows, "k INT, n INT, x DOUBLE, y DOUBLE, name STRING")


def _want(a, b, radius):
    plain = lambda p: p[2] is not None and math.isfinite(p[2])
    pairs = [(p, q) for p in a for q in b if p[0] == q[0] is not None and plain(p) and plain(q)]
    return sorted((p[0], p[1], p[4], q[1], q[4]) for p, q in pairs if math.hypot(p[2] - q[2], p[3] - q[3]) <= radius)


def _rows(pairs):
    return sorted(tuple(r) for r in pairs.select("k", "a_n", "a_name", "b_n", "b_name").collect())


@pytest.mark.parametrize("at_once", [7, 1 << 20])
@pytest.mark.parametrize("in_task", [0, 50, 1 << 12])
def test_pairs_of_two_sides_and_of_one(spark, monkeypatch, in_task, at_once):
    """Keys without the other side, null keys, equal places, distances equal to the radius, places that are no numbers."""
    monkeypatch.setattr(M, "PAIRS_AT_ONCE", at_once)
    (a, left), (b, right) = _points(spark, 1, (1, 2, 3, 4, None)), _points(spark, 2, (2, 3, 5, None))
    got = M.near_pairs(left, right, ["k"], 0.5, in_task)
    assert _rows(got) == _want(a, b, 0.5)
    assert set(got.columns) == {"k", "dist", *(f"{p}_{c}" for p in "ab" for c in ("n", "x", "y", "name"))}
    assert _rows(M.near_pairs(left, left, ["k"], 0.5, in_task)) == _want(a, a, 0.5)


def test_small_keys_are_not_copied_to_cells(spark):
    _, left = _points(spark, 1, (1, 2))
    plan = M.near_pairs(left, left, ["k"], 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
