"""Query of the packing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceframe.llm.packing import Capacities, pack_documents
from traceframe.llm.registry import query, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return pack_documents(table(spark, directory, "documents"), vocabulary(), Capacities(4096))
