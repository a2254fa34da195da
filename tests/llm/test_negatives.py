"""Hard negatives against a plain search of all pairs."""

import math
import random

import pytest

from traceframe.llm.negatives import Mining, hard_negatives, key_parts, pair_key

SCHEMA = "vec_id bigint, label int, embedding array<float>, is_anchor boolean, score double"


def plain(rows, how):
    fit = []
    for i, label, v, a, _ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit.append((i, label, [math.floor(how.scale * x) for x in v], bool(a)))
    out = []
    for i, label, v, a in fit:
        if not a:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w, _ in fit if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][: how.positives]:
            window = [(j, -n) for n, j, m in scored if m != label and -how.low * s <= -100 * n <= -how.high * s][: how.negatives]
            out += [(i, p, k, j, -s, n) for k, (j, n) in enumerate(window, 1)]
    return sorted(out)


def test_keys_keep_the_order():
    rows = [(a, 3, s, k, o, 8) for a in (-2, 5) for s in (-(2**62), -1, 0, 7, 2**62) for k in (0, 1) for o in (-9, 0, 2**62)]
    assert [key_parts(pair_key(*r)) for r in rows] == rows
    assert sorted(rows, key=lambda r: pair_key(*r)) == sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))


def test_all_pairs(spark):
    rng = random.Random(3)
    for how in (Mining(2, 3, block_rows=7, block_anchors=2), Mining(5, 10, 0, 100, block_rows=1000)):
        rows = [(i, rng.randrange(3), [rng.randrange(-2, 5) / 4 for _ in range(3)], i % 6 == 0, 1.0) for i in range(70)]
        rows += [(100 + i, 1, [0.5, 0.5, 0.5], i == 0, 1.0) for i in range(30)]  # ties of one common vector
        rows += [(7, 2, [0.25, 1.0, 0.5], False, 1.0)] * 2  # repeated rows
        rows += [(-4, 0, [1.0, 1.0], True, 1.0), (200, 1, [0.0, 0.0, 0.0], True, 1.0)]  # short and zero vectors
        rows += [(201, None, [1.0] * 3, True, 1.0), (None, 1, [1.0] * 3, False, 1.0), (202, 1, None, True, 1.0)]
        rows += [(203, 1, [1.0, None, 1.0], True, 1.0), (204, 1, [math.inf, 1.0, 1.0], False, 1.0), (205, 2, [math.nan] * 3, True, 1.0)]
        found = hard_negatives(spark.createDataFrame(rows, SCHEMA), how).collect()
        assert sorted(tuple(r) for r in found) == plain(rows, how)
        assert found


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [float(2**20 + i), float(2**19 - 3 * i)], i == 0, 1.0) for i in range(8)]
    found = hard_negatives(spark.createDataFrame(rows, SCHEMA), Mining(low=0, high=100)).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, Mining(low=0, high=100))


def test_windows_lie_below():
    with pytest.raises(ValueError):
        Mining(high=101)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(none).count() == 0
    alone = spark.createDataFrame([(1, 1, [1.0], False, 0.0), (2, 1, [], True, 0.0)], SCHEMA)
    assert hard_negatives(alone).count() == 0
