"""Repeated lines and sentences, repeated bytes: against plain versions."""

from collections import Counter

import numpy as np
import pytest

from traceframe.llm.suffixes import SuffixParameters, remove_repeated_bytes, repeated_places
from traceframe.llm.units import UnitParameters, remove_repeats


def test_earliest_line_stays(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota"
    rows = [(2, f"own words here\n{line}\nend"), (1, line.upper() + "\nrest"), (3, f"{line}\n{line}"), (4, "short line\nshort line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    assert got[1]["text"] == line.upper() + "\nrest" and got[1]["n_removed"] == 0
    assert got[2]["text"] == "own words here\nend"
    assert [tuple(s) for s in got[2]["kept_spans"]] == [(0, 15), (15 + len(line) + 1, 15 + len(line) + 4)]
    assert got[3]["text"] == "" and got[4]["text"] == "short line\nshort line"


def test_passage_within_a_line(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"before one {passage} after one"), (2, f"other start {passage} other end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in remove_repeats(df).collect()}
    assert got[1] == rows[0][1]
    assert len(set(got[2].split()) & set(passage.split())) < 30


def test_awkward_rows_keep_their_bytes(messy, messy_rows, no_rows):
    got = remove_repeats(messy).collect()
    assert len(got) == len(messy_rows) and set(got[0].asDict()) == {*messy.columns, "kept_spans", "n_removed"}
    original = {i: t for i, t in messy_rows}
    for r in got:
        source = original[r["doc_id"]]
        if source is None:
            assert r["text"] is None and r["kept_spans"] == []
        else:
            data = source.encode()
            assert b"".join(data[s["start"] : s["stop"]] for s in r["kept_spans"]) == r["text"].encode()
            assert r["n_removed"] == len(data) - len(r["text"].encode())
    assert next(r for r in got if r["doc_id"] is None)["n_removed"] == 0
    assert remove_repeats(no_rows, UnitParameters()).count() == 0


def plain_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(d), int(gone.sum()), bytes(b for b, g in zip(d, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("p", [SuffixParameters(length=60, gram=12, parts=(1 << 20, 12, 3, 1)), SuffixParameters(length=60, gram=12, limit=1, parts=(1 << 20, 12, 3, 1))])
def test_bytes_against_all_places(messy, messy_rows, no_rows, p):
    got = Counter((r["n_bytes"], r["n_bytes"] - len(r["kept"]), bytes(r["kept"])) for r in remove_repeated_bytes(messy, p).collect())
    assert got == plain_bytes([t for _, t in messy_rows], p.length)
    assert remove_repeated_bytes(no_rows, p).count() == 0


@pytest.mark.parametrize("length", [3, 8, 21])
def test_index_against_counts(length):
    rng = np.random.default_rng(length)
    base = bytes(rng.integers(97, 99, 80).astype(np.uint8))
    contexts = [base[a : a + n] for a, n in zip(rng.integers(0, 60, 15), rng.integers(0, 60, 15))]
    weights = rng.integers(1, 3, 15).astype(float)
    times = Counter()
    for c, w in zip(contexts, weights):
        for i in range(len(c) - length + 1):
            times[c[i : i + length]] += w
    want = [[i for i in range(len(c) - length + 1) if times[c[i : i + length]] >= 2] for c in contexts]
    assert [x.tolist() for x in repeated_places(contexts, weights, length)] == want


def planted(rng, passages):
    """Two documents for each passage, with other words around it; (id, text) and the words a passage has."""
    other = lambda: " ".join(f"own{rng.integers(10**9)}{'.' if rng.random() < 0.1 else ''}" for _ in range(rng.integers(30, 90)))
    rows = [(2 * k + side, f"{other()} {x} {other()}") for k, x in enumerate(passages) for side in (0, 1)]
    rng.shuffle(rows)
    return [(int(i), str(t)) for i, t in rows]


@pytest.mark.parametrize("stops", [0, 4, 7, 15, 60])
def test_passages_of_51_words_at_any_offset(spark, stops):
    rng = np.random.default_rng(stops)
    gap = lambda k: ".\n" if stops and k % (3 * stops) == 0 else ". " if stops and k % stops == 0 else " "
    passages = []
    for x in range(120):
        source = "".join(f"word{rng.integers(5000)}x{x}{gap(k + 1)}" for k in range(140))
        at = x % 80
        words = source.split(" ")
        passages.append(" ".join(words[at:])[: len(" ".join(words[at:]))])
        cut, n = passages[-1], 0
        for end, c in enumerate(cut):  # 51 words, with the white space between them
            n += c in " \n"
            if n == 51:
                passages[-1] = cut[:end]
                break
    assert {len(x.split()) for x in passages} == {51}
    rows = planted(rng, passages)
    got = {r["doc_id"]: r["text"] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    given, left = dict(rows), []
    for k, x in enumerate(passages):
        assert got[2 * k] == given[2 * k]
        assert [w for w in got[2 * k + 1].split() if w[:3] == "own"] == [w for w in given[2 * k + 1].split() if w[:3] == "own"]
        left.append(len(set(got[2 * k + 1].split()) & set(x.split())))
    assert max(left) <= 14 and np.mean(left) < 7


def test_a_passage_that_repeats_in_itself_stays_once(spark):
    rows = [(1, "the " * 100), (1, "the " * 100), (2, " ".join(f"w{k % 30}" for k in range(200))), (3, "the " * 40)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = sorted((r["doc_id"], len(r["text"].split())) for r in got)
    assert size[0] == size[1] and 8 <= size[0][1] <= 40
    assert 30 <= size[2][1] < 90 and set(next(r["text"] for r in got if r["doc_id"] == 2).split()) == {f"w{k}" for k in range(30)}
    assert size[3][1] < 20


def test_units_do_not_depend_on_batches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = lambda df: {r["doc_id"]: r["text"] for r in remove_repeats(df).collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        small = texts(docs.repartition(5))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert small == texts(docs.coalesce(1))
