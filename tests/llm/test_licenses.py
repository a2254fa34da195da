"""License scan: base phrases at all places, the gate and the suppression against plain versions."""

import random
import re

import pytest

from traceframe.llm import licenses as L
from traceframe.llm.licenses_queries import op11_license_scan

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places})


def contained(found, rules):
    """Detections that no other one holds, decided pair by pair in the order of priority, length, place and rule."""
    kept = []
    for d in sorted(found, key=lambda d: (rules[d.rule].priority, d.first - d.last, d.first, d.rule)):
        if not any(k.first <= d.first and d.last <= k.last for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d.first, d.last))


SENTENCES = [
    "Licensed under the Apache License, Version 2.0.",
    "GNU GENERAL PUBLIC LICENSE",
    "the GNU General Public License, version 3 or (at your option) any later version",
    "Released under the MIT License; mit-license MIT licence",
    "CC BY-NC-SA 4.0 cc by, CC\nBY cc/by 3.0",
    "SPDX-License-Identifier: LGPL-2.1",
    "https://creativecommons.org/licenses/by-sa/4.0/",
    "mit freundlichen Grüßen, licenséd public domain",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "unrelated words of a running text",
]


def test_base_and_suppression_match_plain_versions():
    rng = random.Random(5)
    rules = L.signatures()
    assert len(rules) > 300 and [r.priority for r in rules] == sorted(r.priority for r in rules)
    open_gate = tuple(L.Rule(r.label, r.priority, "", r.pattern) for r in rules)
    for _ in range(60):
        text = rng.choice([" ", "\n", ", "]).join(rng.choice(SENTENCES) for _ in range(rng.randrange(0, 9)))
        found = L.scanned(text.encode().translate(L._WORD_BYTES), rules)
        assert found[:5] == plain(text)
        assert set(found[4]) <= set(found[5]) and 0 <= found[6] <= 1
        line = b" ".join(text.encode().translate(L._WORD_BYTES).split()).decode()
        hits = L.detections(line, rules)
        every = [(i, m.start(1), m.end(1)) for i, r in enumerate(open_gate) for m in re.finditer(f"(?<![^ ])(?=((?:{r.pattern}))(?![^ ]))", line)]
        assert sorted((d.rule, d.first, d.last) for d in hits) == sorted((i, line[:a].count(" "), line[:b].count(" ")) for i, a, b in every)
        mine = [(d.first, d.last, rules[d.rule].priority) for d in L.unsuppressed(hits, rules)]
        assert mine == [(d.first, d.last, rules[d.rule].priority) for d in contained(hits, rules)]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (SENTENCES[0], {"apache", "apache-2.0"}),
        (SENTENCES[2], {"gpl", "gpl-3.0-or-later"}),
        (SENTENCES[5], {"lgpl-2.1"}),
        (SENTENCES[6], {"cc-by-sa-4.0"}),
        (SENTENCES[8], {"mit"}),
        (SENTENCES[9], set()),
    ],
)
def test_meaning(text, labels):
    assert set(L.scanned(text.encode().translate(L._WORD_BYTES), L.signatures())[5]) == labels


def test_messy_tables(spark, messy, messy_rows, no_rows):
    rows = L.scan_licenses(messy.withColumnRenamed("kept", "n_words")).collect()
    assert len(rows) == len(messy_rows)
    texts = {i: t for i, t in messy_rows}
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert r.score == 0.5 and r.license_score == 0.0 and r.license_spans == []
    assert L.scan_licenses(no_rows).count() == 0
    long = "word " * 400_000 + "MIT License"
    (row,) = L.scan_licenses(spark.createDataFrame([(1, long)], "doc_id bigint, text string")).collect()
    assert (row.n_words, row.first_word, row.license_labels) == (400_002, 400_000, ["mit"])


def test_query_against_plain(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op11_license_scan(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels.split(",") if r.base_labels else []) == plain(docs[r.doc_id])
