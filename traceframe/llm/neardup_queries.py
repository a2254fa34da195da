"""Query of the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceframe.llm.neardup import near_duplicates
from traceframe.llm.registry import query, table


@query("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return near_duplicates(table(spark, directory, "documents"))
