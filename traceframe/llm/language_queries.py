"""Query of the language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceframe.llm.language import language_scores
from traceframe.llm.registry import query, table


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, directory: str) -> DataFrame:
    return language_scores(table(spark, directory, "documents"))
