"""Samples and structure of whole cases in a task against the same over all tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceframe import session
from traceframe.operators import cases as K
from traceframe.operators import compare as C
from traceframe.operators import groups as G
from traceframe.operators import matching as M
from traceframe.operators import scores as S

STEP = 0.1
SCHEMA = "case_id BIGINT, stroke BIGINT, pos BIGINT, x DOUBLE, y DOUBLE"


def near(row):
    return tuple(round(v, 7) + 0.0 if isinstance(v, float) else v for v in row)


def rows(df):
    return sorted(map(near, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def traces(spark):
    """Scribbles; on a lattice, where lines retrace each other; strokes of one point and without length; unknown places; null keys."""
    rng = random.Random(4)
    out = []
    for case in range(12):
        put = (lambda: rng.randrange(5) / 4 + rng.choice([0, 0.02])) if case % 2 else (lambda: rng.uniform(0, 2))
        for stroke in range(rng.randrange(1, 4)):
            out += [(case, 7 * stroke + 3, i, put(), put()) for i in range(rng.randrange(1, 25))]
    out += [(20, 0, 0, 1.0, 1.0), (21, 0, 0, 1.0, 1.0), (21, 0, 1, 1.0, 1.0), (21, 1, 0, 0.0, 0.0), (21, 1, 1, 3.0, 3.0)]
    out += [(22, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, None), (1.0, 1.0), (0.0, 1.0), (0.6, -0.5), (None, 2.0)])]
    out += [(23, 0, 0, None, 1.0), (23, 0, 1, 1.0, 1.0), (None, 0, 0, 1.0, 1.0), (24, None, 0, 1.0, 1.0)]
    rng.shuffle(out)
    return spark.createDataFrame(out, SCHEMA)


def test_samples_in_a_task(traces):
    want = rows(C.sampled(traces, STEP, in_task=0))
    assert rows(C.sampled(traces, STEP)) == rows(C.sampled(traces, STEP, in_task=20)) == want
    assert len(want) > 1000


@pytest.mark.parametrize("points, samples", [(C.POINTS_OF_CASE, 150), (20, C.SAMPLES_OF_CASE), (20, 150)])
def test_structure_in_a_task(traces, points, samples):
    plain = C.sampled(traces, STEP, in_task=0).select("*")
    want = rows(C.trace_counters(plain, STEP, in_task=0))
    assert {any(r[k] for r in want) for k in range(1, 6)} == {True}
    assert rows(C.trace_counters(C.sampled(traces, STEP), STEP)) == want
    assert rows(C.trace_counters(C.sampled(traces, STEP, in_task=points), STEP, in_task=samples)) == want
    far, near_by = S.structure_places(plain, STEP, in_task=0), S.structure_places(C.sampled(traces, STEP, in_task=points), STEP, in_task=samples)
    assert [rows(d) for d in far] == [rows(d) for d in near_by]


def test_structure_of_a_real_table(spark, tiny):
    from traceframe.plans import views as V

    t = V.traces(spark, tiny)
    assert rows(C.trace_counters(C.sampled(t, STEP), STEP)) == rows(C.trace_counters(C.sampled(t, STEP, in_task=0), STEP, in_task=0))


def test_samples_of_small_cases_are_not_stored(traces, monkeypatch):
    """What is stored follows the points and the cases, not the samples."""
    seen = []
    keep = session.checkpointed
    monkeypatch.setattr(C, "checkpointed", lambda df: seen.append(keep(df)) or seen[-1])
    got = C.trace_counters(C.sampled(traces, 0.002), 0.002)
    assert got.count() == traces.where("case_id IS NOT NULL AND stroke IS NOT NULL").select("case_id").distinct().count()
    assert max(df.count() for df in seen) <= traces.count()


def test_pairs_of_small_keys_are_not_stored(spark, monkeypatch):
    """Ties, points twice, unknown places and keys; matched in a task as in chunks, without rows for pairs."""
    rng = random.Random(9)
    sides = []
    for name in ("ref", "cand"):
        rows_of = [(c, rng.randrange(30) if c == 2 else i, rng.randrange(8) / 8, rng.randrange(8) / 8) for c in range(3) for i in range(60)]
        rows_of += [(None, 1, 0.5, 0.5), (4, 1, None, 0.5), (5, 1, 0.5, float("nan")), (6 if name == "ref" else 7, 1, 0.5, 0.5)]
        sides.append(spark.createDataFrame(rows_of, f"k INT, {name} BIGINT, x DOUBLE, y DOUBLE"))
    seen = []
    keep = session.checkpointed
    monkeypatch.setattr(M, "checkpointed", lambda df: seen.append(keep(df)) or seen[-1])
    got = rows(M.greedy_one_to_one(*sides, ["k"], 0.6))
    assert all(df.count() <= 400 for df in seen)
    assert got == rows(M.greedy_one_to_one(*sides, ["k"], 0.6, limit=13)) and len(got) > 100


def test_targets_take_few_plans(traces, monkeypatch):
    """Each plan that is stored stays with the driver: words and letters of small cases take as many whatever their structure."""
    seen = []
    for module in (C, M, G):
        monkeypatch.setattr(module, "checkpointed", lambda df: seen.append(len(df._jdf.queryExecution().executedPlan().toString())) or session.checkpointed(df))
    letters = traces.withColumn("case_id", F.col("case_id") * 100 + F.col("stroke"))
    for t in (traces, letters):
        C.trace_counters(C.sampled(t, STEP), STEP).collect()
    assert 2 <= len(seen) <= 8 and sum(seen) < 100_000


def test_cases_of_a_thousand_points_are_aligned_together(monkeypatch):
    """On a lattice, with an unknown place in one: paths and costs as of one case at a time."""
    rng = np.random.default_rng(3)
    n, m = np.array([930, 700, 5, 911]), np.array([880, 960, 7, 1])
    xy = rng.integers(0, 4, ((n + m).sum(), 2)).astype(float)
    xy[-900, 0] = np.nan
    first = np.cumsum(n + m) - (n + m)
    one = [C.alignment_path(xy[f : f + a], xy[f + a : f + a + b][::-1]) for f, a, b in zip(first, n, m)]
    monkeypatch.setattr(C, "alignment_path", None)
    case, i, j, cost = C.alignment_paths(xy, first, n, m, back=True)
    for k, (p, q, c) in enumerate(one):
        assert np.array_equal(p, i[case == k]) and np.array_equal(q, j[case == k])
        assert c == cost[k] or np.isnan(c) and np.isnan(cost[k])


def test_nearest_points_do_not_meet_all_points():
    """Cases of any scale, ties, unknown places: the first of the nearest, or left to the caller, which few are."""
    rng = np.random.default_rng(5)
    n, m = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    of, to = np.repeat(np.arange(40), n), np.repeat(np.arange(40), m)
    for put in (lambda k: rng.random(k) * 9, lambda k: rng.integers(0, 6, k).astype(float), lambda k: rng.random(k) * 10.0 ** rng.integers(-4, 5, k)):
        x, y, u, v = (put(len(w)) for w in (of, of, to, to))
        x[3], v[5], u[9] = np.nan, np.inf, np.nan
        dist, row = K.nearest_rows(of, x, y, to, u, v)
        for i in np.flatnonzero(row >= 0):
            others = np.flatnonzero(to == of[i])
            gap = np.nan_to_num(np.hypot(x[i] - u[others], y[i] - v[others]), nan=np.inf)
            assert dist[i] == gap.min() and row[i] == others[gap.argmin()]
        if x[np.isfinite(x)].max() < 10:
            assert (row[np.isin(of, to)] < 0).sum() <= 0.1 * len(of)
