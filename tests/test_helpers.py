"""Skew-safe helpers against plain Python, with limits small enough that every split path runs."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceframe.functions import ordered as O
from traceframe.functions import quantiles as Q
from traceframe.functions.stats import binomial_two_sided


@pytest.fixture
def values(spark):
    rng = random.Random(7)
    rows = [("hot", i, float(rng.choice([1, 2, 2, 2, rng.random() * 50]))) for i in range(3000)]
    rows += [("cold", i, rng.random()) for i in range(7)]
    return rows, spark.createDataFrame(rows, "k STRING, id BIGINT, v DOUBLE")


@pytest.mark.parametrize("limit", [0, 10**6])
def test_quantiles_bracket_and_array(values, monkeypatch, limit):
    rows, df = values
    monkeypatch.setattr(Q, "SMALL_GROUP", limit)
    monkeypatch.setattr(Q, "EXACT_SKETCH", 20)
    monkeypatch.setattr(Q, "ACCURACY", 100)
    wanted = {"m": 0.5, "p9": 0.9, "e": (0.1, "half_even"), "u": (0.95, "half_up"), "f": (0.9, "floor_n")}
    got = {r["k"]: r for r in Q.exact_quantiles(df, ["k"], "v", wanted, "n").collect()}
    for k in ("hot", "cold"):
        v = sorted(x for g, _, x in rows if g == k)
        n = len(v)
        assert got[k]["n"] == n
        assert got[k]["m"] == pytest.approx(statistics.median(v))
        assert got[k]["p9"] == pytest.approx(np.percentile(v, 90))
        assert got[k]["e"] == v[round(0.1 * (n - 1))]
        assert got[k]["u"] == v[int(0.95 * (n - 1) + 0.5)]
        assert got[k]["f"] == v[min(n - 1, int(0.9 * n))]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_median_and_mad(values, monkeypatch, limit):
    rows, df = values
    monkeypatch.setattr(Q, "SMALL_GROUP", limit)
    got = {r["k"]: r for r in Q.median_and_mad(df, ["k"], "v", ("m", "d")).collect()}
    v = [x for g, _, x in rows if g == "hot"]
    m = statistics.median(v)
    assert got["hot"]["m"] == pytest.approx(m)
    assert got["hot"]["d"] == pytest.approx(statistics.median(abs(x - m) for x in v))


def test_quantiles_of_null_keys_and_nan_beside_a_huge_group(spark):
    nan = float("nan")
    small = spark.createDataFrame(
        [(None, 1.0), (None, 2.0), (None, 4.0), ("n", 1.0), ("n", 2.0), ("n", nan), ("n", None), ("all", nan), ("none", None)],
        "k STRING, v DOUBLE",
    )
    huge = spark.range(60_000).select(F.lit("huge").alias("k"), F.when(F.col("id") % 4 == 0, nan).otherwise(F.col("id") + 0.0).alias("v"))
    wanted = {"m": 0.5, "p9": (0.9, "half_up")}
    rows = lambda df: {r["k"]: str(tuple(r)[1:]) for r in df.collect()}
    for other in (None, huge):
        df = small if other is None else small.unionByName(other)
        got = rows(Q.exact_quantiles(df, ["k"], "v", wanted, "n"))
        huge_row = {}
        if other is not None:
            numbers = sorted(x for x in range(60_000) if x % 4)
            huge_row = {"huge": str(((numbers[29_999] + numbers[30_000]) / 2, nan, 60_000))}
        assert got == {None: "(2.0, 4.0, 3)", "n": "(2.0, nan, 3)", "all": "(nan, nan, 1)"} | huge_row
        one = rows(Q.exact_quantiles(df, ["k"], "v", {"p9": (0.9, "half_up")}))
        assert {k: one[k] for k in (None, "n", "all")} == {None: "(4.0,)", "n": "(nan,)", "all": "(nan,)"}
        mad = rows(Q.median_and_mad(df, ["k"], "v", ("m", "d")))
        assert {k: mad[k] for k in (None, "n", "all")} == {None: "(2.0, 1.0)", "n": "(2.0, 1.0)", "all": "(nan, nan)"}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_ordered_chunks(spark, chunk):
    xs = [3.0, None, 5.0, 1.0, None, None, 2.0, 8.0, None, 4.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "k STRING, pos BIGINT, x DOUBLE")
    n = O.neighbours(df, ["k"], "pos", {"p": ("x", -1), "n2": ("x", 2)}, chunk if chunk > 1 else 2)
    t = O.running_total(n, ["k"], "pos", {"s": "x"}, chunk)
    c = O.carried(t, ["k"], "pos", {"lo": "x"}, chunk=chunk)
    c = O.carried(c, ["k"], "pos", {"hi": "x"}, backward=True, chunk=chunk)
    c = O.running_max(c, ["k"], "pos", "x", "top", chunk)
    rows = c.orderBy("pos").collect()
    total, last, top = 0.0, None, None
    for i, r in enumerate(rows):
        assert r["p"] == (xs[i - 1] if i else None)
        assert r["n2"] == (xs[i + 2] if i + 2 < len(xs) else None)
        assert r["top"] == top
        if xs[i] is not None:
            total, last = total + xs[i], xs[i]
            top = xs[i] if top is None else max(top, xs[i])
        assert r["s"] == pytest.approx(total)
        assert r["lo"] == last
        assert r["hi"] == next((x for x in xs[i:] if x is not None), None)


@pytest.mark.parametrize("limit", [10, 10**6])
def test_dense_rank(values, monkeypatch, limit):
    rows, df = values
    monkeypatch.setattr(O, "CHUNK", limit)
    got = O.dense_rank_of(df, ["k"], "v", "id", "r", descending=True).collect()
    for k in ("hot", "cold"):
        want = sorted(((v, i) for g, i, v in rows if g == k), key=lambda p: (-p[0], p[1]))
        order = sorted((r for r in got if r["k"] == k), key=lambda r: r["r"])
        assert [r["r"] for r in order] == list(range(len(want)))
        assert [(r["v"], r["id"]) for r in order] == want


def test_binomial_tail(spark):
    pairs = [(0, 1), (1, 3), (9, 19), (40, 100), (480, 1000), (0, 0)]
    df = spark.createDataFrame(pairs, "k BIGINT, n BIGINT").select("k", "n", binomial_two_sided(F.col("k"), F.col("n")).alias("p"))
    for r in df.collect():
        if r["n"] == 0:
            assert r["p"] is None
        else:
            want = min(1.0, 2 * sum(math.comb(r["n"], i) for i in range(r["k"] + 1)) / 2 ** r["n"])
            assert r["p"] == pytest.approx(want, abs=1e-9)
