"""Plans that the driver holds stay small: a step that reads its input more than once starts from a checkpoint."""

from __future__ import annotations

import pytest

from traceframe import session
from traceframe.operators import compare as C
from traceframe.operators import matching as M
from traceframe.operators import scores as S
from traceframe.plans import views as V

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def plans(monkeypatch):
    """Lengths of all plans that are checkpointed."""
    seen: list[int] = []
    real = session.checkpointed

    def noted(df):
        seen.append(len(df._jdf.queryExecution().executedPlan().toString()))
        return real(df)

    for module in (C, M, S):
        monkeypatch.setattr(module, "checkpointed", noted)
    return seen


def test_structure_counters_keep_plans_small(spark, plans):
    C.trace_counters(C.sampled(V.traces(spark, SMALL), 0.25), 0.25)
    assert max(plans) < 200_000


def test_targets_keep_plans_small(spark, plans):
    """Words, and the same strokes as cases of their own, as cp11 counts them."""
    t = V.traces(spark, SMALL)
    single = t.withColumn("case_id", t.case_id * 100 + t.stroke)
    C.trace_counters(C.sampled(single, 0.25), 0.25)
    assert max(plans) < 200_000
