"""Stages of the pipeline against brute force."""

import corpus_pipeline
from test_neardup import plain

SMALL = "/root/testdata/sf0.001"


def kept(stage, spark, docs):
    return sorted(r["doc_id"] for r in stage(spark, docs, SMALL).select("doc_id").collect())


def smallest(rows, percent):
    return sorted(i for i, _, root in plain(rows, percent) if i == root)


def test_near_copies_from_eight_tenths(spark):
    text = lambda name, n, other=0: " ".join([f"{name}{k}" for k in range(n - other)] + [f"{name}x{k}" for k in range(other)])
    # 90 shingles with 10 others: exactly 0.8; 100 with 11: 0.802, with 12: 0.786, with 8: 0.852
    rows = [(1, text("a", 94)), (2, text("a", 94, 10)), (3, text("b", 104)), (4, text("b", 104, 11)), (5, text("c", 104)), (6, text("c", 104, 12)), (7, text("d", 104)), (8, text("d", 104, 8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(corpus_pipeline.near_copies, spark, docs) == smallest(rows, 80) == [1, 3, 5, 6, 7]


def test_near_copies_of_real_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert kept(corpus_pipeline.near_copies, spark, docs) == smallest(rows, 80)
