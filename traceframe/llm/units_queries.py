"""Query of the substring dedup by lines and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceframe.llm.registry import query, table
from traceframe.llm.units import remove_repeats


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "text", "kept_spans", "n_removed")
