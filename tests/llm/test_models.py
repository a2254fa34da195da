"""Classifier, language model, decontamination, packing, pipeline: held-out accuracy, plain versions, awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from traceframe.llm.classifier import ClassifierParameters, log_loss, quality_scores, train
from traceframe.llm.decontaminate import benchmark_leaks, common_length
from traceframe.llm.language import LanguageParameters, Totals, Seating, language_scores, model_probabilities, seat
from traceframe.llm.packing import Capacities, best_fit, encoder, pack_documents
from traceframe.llm.packing_queries import vocabulary

SMALL = "/root/testdata/sf0.01"
SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- classifier


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    got = quality_scores(docs, known).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.values, got[got.quality == 0].score.values
    assert np.mean(good[:, None] > bad[None, :]) > 0.9
    assert set(got.held_out) == {True} and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)


def test_classifier_awkward_rows(spark, messy, messy_rows, no_rows):
    labels = spark.createDataFrame([(1, 1), (7, 0), (9, 1), (9, 0), (13, None), (99, 1)], "id bigint, label int")
    p = ClassifierParameters(buckets=1 << 10, epochs=3)
    got = quality_scores(messy, labels, p).collect()
    assert len(got) == len(messy_rows) and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (4, 5, 6)}
    assert len(blank) == 1
    flat = quality_scores(messy, labels.limit(0), p).collect()
    assert {r["score"] for r in flat} == {0.5}
    assert quality_scores(no_rows, labels, p).count() == 0


def test_temperature_is_the_best_for_the_rows_held_back():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    check = np.arange(600) % 5 == 0
    net = train(x, y, check, ClassifierParameters(epochs=80, dims=2))
    z = net.logits(x[check])
    best = log_loss(z / net.temperature, y[check])
    assert all(best <= log_loss(z / t, y[check]) + 1e-9 for t in (0.25, 0.5, 0.9, 1.0, 1.1, 2.0, 8.0) if t != net.temperature)
    assert np.mean((net.scores(x) > 0.5) == y) > 0.7


# ---------------------------------------------------------------- language model


def test_base_score_and_awkward_rows(messy, messy_rows, no_rows):
    got = language_scores(messy).collect()
    tokens = lambda t: re.findall(SPACE, (t or "").translate(LOWER)) + ["\0end"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(w for i, t in messy_rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n) for i, t in messy_rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
    texts = dict(messy_rows)
    for r in got:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(texts[r["doc_id"]]))
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert language_scores(no_rows).count() == 0


def test_predictive_probabilities_sum_to_one():
    p = LanguageParameters(classes=8, parents=2)
    rng = np.random.default_rng(2)
    counts = rng.poisson(2, (50, 8))
    counts[:, 0] += 1
    word, klass = np.nonzero(counts)
    s = Seating(np.arange(50, dtype=np.uint64), word, klass, counts[word, klass].astype(np.int64), p)
    for k in range(3):
        t = s.totals()
        s.sweep(t, np.random.default_rng(k))
    t = s.totals()
    d = t.discounts()
    assert np.all(s.tables[0] <= s.counts) and np.all(s.tables[0] >= 1)
    state = np.zeros((4, 50 * 8), dtype=np.int64)
    cell = word * 8 + klass
    group = np.zeros((50, 2, 2), dtype=np.int64)
    group[s.group_word, s.group_parent] = np.stack([s.middle, s.tables[1]], axis=1)
    state[0, cell], state[1, cell] = s.counts, s.tables[0]
    state[2:] = group[np.arange(400) // 8, np.arange(400) % 8 // p.per_parent].T
    probability = model_probabilities(np.arange(400) % 8, np.arange(400) // 8, s.unigram(t, d)[None], state, [t], p).reshape(50, 8).sum(axis=0)
    unknown = (p.strength + d[2] * t.tables[2][0]) / (t.types + 1) / (p.strength + t.customers[2][0])
    parent = (p.strength + d[1] * t.tables[1]) / (p.strength + t.customers[1]) * unknown
    own = (p.strength + d[0] * t.tables[0]) / (p.strength + t.customers[0]) * parent[np.arange(8) // p.per_parent]
    assert probability + own == pytest.approx(np.ones(8))
    assert isinstance(Totals.read(t.flat(), p), Totals)


def test_seating_is_within_bounds_for_any_count():
    c = np.array([0, 1, 2, 15, 17, 1000, 10**7])
    t = seat(c, np.full(7, 2.0), 0.5, np.random.default_rng(1))
    assert t[0] == 0 and t[1] == 1 and np.all(t <= c) and t[6] > t[5] > 1


# ---------------------------------------------------------------- decontamination


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def test_common_length():
    rng = random.Random(4)
    for _ in range(40):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
        assert common_length(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == plain_common(a, b)


def test_leaks_are_found(spark, messy, no_rows):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(300))
    items = [(i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(6)) + ".", i) for i in range(6)] + [(6, None, 6), (7, "", 7)]
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id long")
    filler = lambda n: " ".join(word() for _ in range(n))
    edited = items[2][1].split()
    edited[5], edited[11] = "other", "words"
    docs = [(100, f"{filler(300)} {items[0][1]} {filler(100)}"), (101, items[1][1].upper()), (102, f"{filler(75)} {' '.join(edited)}"), (103, filler(400)), (104, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = benchmark_leaks(df.unionByName(messy.select("doc_id", "text")), bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(100, 0), (101, 1), (102, 2)}
    assert benchmark_leaks(no_rows, bench).count() == 0 and benchmark_leaks(df, bench.limit(0)).count() == 0


# ---------------------------------------------------------------- packing


def test_pieces_and_sequences(messy, messy_rows, no_rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    got = pack_documents(messy, vocabulary(), Capacities(512)).collect()
    ids = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 1]
    want = Counter()
    for i, t in messy_rows:
        x = ids(t)
        for k in range(0, len(x), 512):
            part = x[k : k + 512]
            want[i, k // 512, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 512
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 512) + 2
    assert pack_documents(no_rows, vocabulary(), Capacities(512)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(3).integers(1, 60, 400)
    cap = Capacities(100, documents=4, attention=4000, rule=rule)
    chosen, _ = best_fit(lengths, cap)
    for b in np.unique(chosen):
        x = lengths[chosen == b]
        assert x.sum() <= 100 and len(x) <= 4 and (x * x).sum() <= 4000
    assert best_fit(np.zeros(0, dtype=np.int64), cap)[0].size == 0


@pytest.mark.parametrize("text", ["á e ́x \x1cq\x1d  z y <|endoftext|> it's I'LL ﬁ İ ß​q", "\t\x0b\r\n x", "12345 ab12cd … 日本語", "¼ ½x ² ª º µ ŉ", "don't!'s 're"])
def test_memo_equals_the_tokenizer(text):
    e = encoder(vocabulary())
    assert e.document(text) == e.ids(text).tobytes() == e.document(text)


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    tiny = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    size = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, tiny))
        assert docs.columns == columns, name
        rows = docs.collect()
        left, was, size = {r["doc_id"] for r in rows}, size, sum(len(r["text"] or "") for r in rows)
        if name == "substring_dedup":  # cuts texts; a document goes only if nothing is left
            assert left <= ids and size < was and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
        else:
            assert left < ids, name
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
    assert {r["doc_id"] for r in packed.collect()} == ids


def test_wholly_repeated_document_goes(spark):
    lines = ["one two three four five six seven eight nine", "ten eleven twelve thirteen fourteen fifteen sixteen seventeen"]
    rows = [(1, "\n".join(lines), 99), (2, lines[1], 99), (3, "own words\n" + lines[0], 99), (4, None, None), (5, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_units(spark, docs, SMALL).collect()}
    assert got == {1: (rows[0][1], 99), 3: ("own words\n", 10), 4: (None, None), 5: ("", 0)}


def test_pipeline_on_no_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
