"""From raw documents to packed training sequences: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage reads the documents that the one before kept, in the columns of `documents`; the last one returns token pieces and
their places in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.classifier import quality_scores
from traceframe.llm.classifier_queries import ACCEPT
from traceframe.llm.common import stored
from traceframe.llm.decontaminate import benchmark_leaks
from traceframe.llm.neardup import NearDup, near_duplicates
from traceframe.llm.packing import Capacities, pack_documents
from traceframe.llm.packing_queries import vocabulary
from traceframe.llm.registry import table
from traceframe.llm.units import remove_repeats

SEQUENCE_TOKENS = 4096
#: Shingles of five words, similarity 0.8 or more. A pair of exactly 0.8 shares no band with a chance of 2 in a million.
NEAR = NearDup(percent=80, bands=55, rows=7, slack=0.16)


def _of(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` whose id is (`left_semi`) or is not (`left_anti`) among `ids`; null ids equal each other."""
    other = ids.select(F.col("doc_id").alias("__id"))
    return docs.join(other, docs["doc_id"].eqNullSafe(other["__id"]), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts. Rows that repeat an id stay if one of them is accepted."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return _of(docs, quality_scores(docs, labels).where(F.col("score") >= ACCEPT), "left_semi")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return _of(docs, near_duplicates(docs, NEAR).where("kept"), "left_semi")


def repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and sentences that an earlier one has; those with nothing left go. `n_chars` is made anew."""
    left = remove_repeats(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", size).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return _of(docs, benchmark_leaks(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents left and where they go."""
    return pack_documents(docs, vocabulary(), Capacities(SEQUENCE_TOKENS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_copies),
    ("substring_dedup", repeated_units),
    ("benchmark_decontamination", benchmark_free),
    ("best_fit_packing", packed),
]

#: Trained models and exact packing have no SQL form; the near-copy stage is tested against all pairs, the others by their operators' tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
