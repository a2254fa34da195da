"""Query of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceframe.llm.decontaminate import benchmark_leaks
from traceframe.llm.registry import query, table


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return benchmark_leaks(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
