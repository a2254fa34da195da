"""Near duplicates against all pairs."""

import re

import numpy as np
import pytest

from traceframe.llm.neardup import NearDup, _Signer, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if i is not None and j is not None and s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("p", [NearDup(), NearDup(block_docs=1)])
def test_against_all_pairs(messy, messy_rows, p):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(messy, p).collect()), key=str)
    assert got == plain(messy_rows)


@pytest.mark.parametrize("p", [NearDup(), NearDup(block_docs=1)])
def test_repeated_ids_with_other_texts(spark, p):
    rng = np.random.default_rng(5)
    text = lambda: [f"w{k}" for k in rng.integers(10**6, size=300)]

    def near(words):
        return " ".join([*words[:150], "changed", *words[151:]])

    a, b, c, d, e = text(), text(), text(), text(), text()
    rows = [
        (1, " ".join(a)), (2, near(a)), (5, " ".join(b)), (2, near(b)),
        (3, " ".join(c)), (4, " ".join(c)), (4, " ".join(d)), (7, near(d)), (8, ""), (8, near(c)), (8, None),
        (9, " ".join(e)), (9, "alone"), (10, "alone"), (11, None), (12, near(e)), (12, near(e)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df, p).collect()), key=str)
    assert got == plain(rows)


def test_real_slice(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = near_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_empty_table(no_rows):
    assert near_duplicates(no_rows).count() == 0


def test_odd_sketch_tells_similar_from_unlike():
    p = NearDup()
    signer, rng = _Signer(p), np.random.default_rng(1)
    s = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    bits = lambda x: np.frombuffer(signer.sign(x)[3], dtype=np.uint64)
    apart = lambda x, y: int(np.bitwise_count(bits(x) ^ bits(y)).sum())
    other = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    assert apart(s, s) == 0
    assert apart(s, s[:900]) < p.most_odd_bits() < apart(s, other)
