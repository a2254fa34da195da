"""Inputs whose groups are nearly as many as their rows."""

from __future__ import annotations

from traceframe.plans import views as V


def test_groups_of_a_scan_take_more_tasks_than_its_splits(spark, tiny):
    scan = V.table(spark, tiny, "lineitem")
    assert V.dealt(scan, ["l_suppkey"]).rdd.getNumPartitions() == V.TASKS_OF_SPLIT * scan.rdd.getNumPartitions()
    assert "REPARTITION_BY_NUM" in V.arm_rows(spark, tiny)._jdf.queryExecution().executedPlan().toString()
