"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.classifier import quality_scores
from traceframe.llm.registry import query, table

ACCEPT = 0.3


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    labels = table(spark, directory, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    scored = quality_scores(table(spark, directory, "documents"), labels)
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
