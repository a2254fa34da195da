"""Quantiles of a great many small groups against the sketched form."""

from __future__ import annotations

import random

from traceframe.functions import quantiles as Q


def test_many_groups_without_a_sketch(spark, monkeypatch):
    """Groups below and above the limit, null keys, NaN, nulls and ties; no sketch is built for the small ones."""
    rng = random.Random(3)
    values = [None, float("nan"), float("inf"), *(float(rng.randrange(9)) for _ in range(20))]
    rows = [(k if k % 11 else None, k % 2, rng.choice(values)) for k in (rng.randrange(60) ** 2 // 60 for _ in range(3000))]
    df = spark.createDataFrame(rows, "a INT, b INT, v DOUBLE")
    wanted = {"m": 0.5, "p": 0.9, "f": (0.3, "floor_n"), "e": (0.7, "half_even")}
    want = sorted(map(str, Q.exact_quantiles(df, ["a", "b"], "v", wanted, "n").collect()))
    whole = Q.exact_quantiles(df, ["a", "b"], "v", wanted, "n", many=True)
    assert "percentile_approx" not in whole._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(Q, "SMALL_GROUP", 40)
    parted = Q.exact_quantiles(df, ["a", "b"], "v", wanted, "n", many=True)
    assert "percentile_approx" in parted._jdf.queryExecution().optimizedPlan().toString()
    for got in (whole, parted):
        assert sorted(map(str, got.collect())) == want
