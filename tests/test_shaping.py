"""Shaping of words inside their rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from traceframe.operators import words as Wd

WORDS = ["Haus|tür", "Kunst,", "s", "st", "", "|", None, "\"ab\"", "1s9", "ssſs|s", "☘n", "a.b.c", "ausaus", "x" * 300 + "s"]


@pytest.fixture
def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word STRING")


def test_shaping_neither_sorts_nor_shuffles(words):
    plan = Wd.tokens(words, ["word"], "word")._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Window", "Sort", "Exchange hashpartitioning"))


def test_places_and_keys(words):
    got = {}
    for r in Wd.tokens(words, ["word"], "word").orderBy("word", "i").collect():
        got.setdefault(r["word"], []).append((r["i"], r["text"], r["key"], r["position"], r["ligature"], r["joins"], r["quote"]))
    assert set(got) == {w for w in WORDS if w not in ("", "|", None)}
    assert got["Kunst,"][3:] == [(3, "st", "longst", "final", True, True, False), (4, ",", "comma", "initial", False, False, False)]
    assert [(i, p) for i, _, _, p, *_ in got["1s9"]] == [(0, "initial"), (1, "initial"), (2, "initial")]
    assert [k for _, _, k, *_ in got["ssſs|s"]] == ["longs", "longs", "longs", "s", "s"]
    assert [(k, p) for _, _, k, p, *_ in got['"ab"']] == [(None, "initial"), ("a", "initial"), ("b", "final"), (None, "initial")]
    assert [(k, p) for _, _, k, p, *_ in got["☘n"]] == [(None, None), ("n", "initial")]


def test_once_counts_what_the_tokens_hold(words):
    every = Wd.tokens(words, ["word"], "word").groupBy("word", "key", "position").agg(F.count(F.lit(1)).alias("n"))
    once = Wd.tokens(words, ["word"], "word", ["key", "position"])
    assert sorted(map(str, once.select(*every.columns).collect())) == sorted(map(str, every.collect()))


def test_coverage_of_keys_once(spark, words):
    inv = spark.createDataFrame([("a", True), ("u", True), ("s", False)], "key STRING, ready BOOLEAN")
    every = Wd.coverage(Wd.tokens(words, ["word"], "word"), inv, ["word"])
    once = Wd.coverage(Wd.tokens(words, ["word"], "word", ["key"]), inv, ["word"], once=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, every.collect()))
