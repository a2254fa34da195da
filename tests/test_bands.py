"""Bands of components, as one row for each key and one by one."""

from __future__ import annotations

import random

import pytest

from traceframe.operators import matching as M


@pytest.mark.parametrize("in_row", [0, 3, 1 << 10])
def test_bands_in_a_row_and_one_by_one(spark, in_row):
    """Keys with and without bands, null keys, ties and nulls."""
    rng = random.Random(7)
    span = lambda: sorted((rng.randrange(40) / 2, rng.randrange(40) / 2))
    comps = [(k, n, *span()) for k in (0, 1, 2, 3, None) for n in range(25)] + [(2, 90, None, 4.0)]
    bands = [(k, n, *span()) for k, many in ((0, 2), (1, 5), (2, 9), (4, 2), (None, 2)) for n in range(many)]

    def place(k, y0, y1):
        own = [b for b in bands if k is not None and b[0] == k]
        lo, hi = (y for y in (y0 if y0 is not None else y1, y1))
        over = max(((min(hi, b1) - max(lo if y0 is not None else b0, b0), n) for _, n, b0, b1 in own), default=(0, None))
        under = min(((b0 - (y0 + y1) / 2, n) for _, n, b0, _ in own if y0 is not None and b0 >= (y0 + y1) / 2), default=(99, None))
        return over[1] if over[0] > 0 else under[1] if under[0] <= 4 else None

    c = spark.createDataFrame(comps, "k INT, id INT, y0 DOUBLE, y1 DOUBLE")
    b = spark.createDataFrame(bands, "k INT, band INT, b0 DOUBLE, b1 DOUBLE")
    got = M.assigned_to_bands(c, b, ["k"], 4.0, in_row)
    assert got.columns == ["k", "id", "y0", "y1", "band"]
    want = sorted((str(k), n, place(k, y0, y1)) for k, n, y0, y1 in comps)
    assert sorted((str(r["k"]), r["id"], r["band"]) for r in got.collect()) == want


def test_a_component_meets_the_bands_of_its_key_once(spark):
    c = spark.createDataFrame([(1, 1, 0.0, 1.0)], "k INT, id INT, y0 DOUBLE, y1 DOUBLE")
    b = spark.createDataFrame([(1, n, 0.0, float(n)) for n in range(9)], "k INT, band INT, b0 DOUBLE, b1 DOUBLE")
    plan = M.assigned_to_bands(c, b, ["k"], 4.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "SortAggregate" not in plan
