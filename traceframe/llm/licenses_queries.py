"""Query of the license scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.licenses import scan_licenses
from traceframe.llm.registry import query, table


@query("op11_license_scan")
def op11_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    found = scan_licenses(table(spark, directory, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "license_labels").alias("labels"),
        F.col("license_score").alias("score"),
    )
