"""Query of the repeated-bytes dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.registry import query, table
from traceframe.llm.suffixes import remove_repeated_bytes


@query("op8_suffix_array_dedup")
def op8_suffix_array_dedup(spark: SparkSession, directory: str) -> DataFrame:
    left = remove_repeated_bytes(table(spark, directory, "documents"))
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
