"""Quality rules and URL filter: against SQL on the small tables, by hand on awkward rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from traceframe.llm import rules
from traceframe.llm.urls import Rule, TreeParameters, url_filter


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_follow_a_plain_version(messy, messy_rows):
    got = Counter(tuple(r) for r in rules.quality_rules(messy).select("doc_id", "q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words").collect())
    assert got == Counter((i, *plain_counts(t)) for i, t in messy_rows)


def test_thresholds_name_the_rules_missed(spark):
    df = spark.createDataFrame([(1, "A!! | | | | ##"), (2, None)], "doc_id long, text string")
    table = (rules.Threshold("long", "n_words", 3), rules.Threshold("symbols", "symbol_share", None, 0.5))
    got = {r["doc_id"]: (r["failed_rules"], r["kept"]) for r in rules.quality_rules(df, table).collect()}
    assert got == {1: (["symbols"], False), 2: (["long"], False)}
    assert rules.quality_rules(df.limit(0), table).count() == 0


def test_rules_run_without_python(messy):
    plan = rules.quality_rules(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


RULES = (Rule("block", "bad/"), Rule("allow", "ok.bad/x/"))


def test_longest_rule_wins_and_odd_urls(spark):
    urls = [None, "", "no scheme", "http://A.BAD/x/1", "http://ok.bad/x/2", "http://s.ok.bad/y", "http://notbad/q", "http://bad", "x://h?q/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(df, RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.bad", "/x/1", "bad/", "block")
    assert got[4] == ("ok.bad", "/x/2", "ok.bad/x/", "allow")
    assert got[5] == ("s.ok.bad", "/y", "bad/", "block")
    assert got[6] == ("notbad", "/q", None, "allow")
    assert got[7] == ("bad", "", None, "allow")
    assert got[8] == ("h", "", None, "allow")
    assert url_filter(df.limit(0), RULES).count() == 0


def test_templates_are_judged_by_their_labels(spark):
    rows = [(f"http://h/spam/{i}/a", i < 20) for i in range(20)] + [(f"http://h/news/{i}/a", False) for i in range(20)]
    rows += [("http://h/spam/99/a", None), ("http://h/news/99/a", None), ("http://h/new/7", None)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    got = {r["url"]: (r["template"], r["verdict"]) for r in url_filter(df, (), bad=F.col("bad"), p=TreeParameters()).collect()}
    assert got["http://h/spam/99/a"] == ("/spam/#/a", "block")
    assert got["http://h/news/99/a"] == ("/news/#/a", "allow")
    assert got["http://h/new/7"] == ("/*/*", "allow")


@pytest.mark.parametrize("text,want", [("a b c a b c", 6), ("a a a a", 4), ("a b", 0), ("a b c d", 0)])
def test_repeated_windows(spark, text, want):
    assert rules.measured(spark.createDataFrame([(text,)], "text string")).first()["n_repeat_words"] == want
