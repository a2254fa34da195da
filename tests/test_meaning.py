"""Hand-computed cases for shapes, words, gates and coverage."""

import pytest
from pyspark.sql import functions as F

from traceframe.functions import text as X
from traceframe.operators import checks as Ch
from traceframe.operators import geometry as G
from traceframe.operators import shape_stats as S
from traceframe.operators import words as Wd

OCC = "glyph_key STRING, seq BIGINT, anchors ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"


def occurrences(spark, points):
    return spark.createDataFrame([("a", i, p) for i, p in enumerate(points)], OCC)


def test_group_profile(spark):
    four = [[(0.0, 0.0), (x, y)] for x, y in ((1.0, 1.0), (3.0, 1.0), (5.0, 4.0), (7.0, 4.0))]
    occ = occurrences(spark, [*four, [(0.0, 0.0)] * 3])
    shaped = S.modal_shape(occ, ["glyph_key"])
    assert shaped.where(~F.col("kept")).count() == 1
    p = S.element_median_mad(S.points_long(shaped.where("kept"), ["glyph_key"]), ["glyph_key"]).where("i = 1").first()
    assert (p["med_x"], p["med_y"], p["mad_x"], p["mad_y"]) == (4.0, 2.5, 2.0, 1.5)
    gate = S.gated_groups(occurrences(spark, four[:3]), ["glyph_key"], 4).first()
    assert (gate["n_instances"], gate["below_min_n"]) == (0, 3)


def test_zero_length_connector_repeats_its_point(spark):
    df = spark.createDataFrame([("l", (1.0, 2.0), [(3.0, 4.0), (3.0, 4.0)])], "k STRING, offset STRUCT<x: DOUBLE, y: DOUBLE>, connector ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
    pts = S.transition_points(df, ["k"]).where("i >= 0").collect()
    assert len(pts) == 24 and all((p["x"], p["y"]) == (3.0, 4.0) for p in pts)


@pytest.mark.parametrize(
    ("word", "keys"),
    [
        ("lesen", "l e longs e n"),
        ("das", "d a s"),
        ("Fuß", "F u sz"),
        ("Buch", "B u ch"),
        ("Glück", "G l ue ck"),
        ("Haus|tür", "H a u s t ue r"),
        ("Aus|tritt", "A u s t r i t t"),
        ("Haus,", "H a u s comma"),
        ("Kunst", "K u n longst"),
        ("China", "C h i n a"),
        ("1922", "1 9 2 2"),
        ("☘n", "? n"),
    ],
)
def test_shaping(spark, word, keys):
    t = Wd.tokens(spark.createDataFrame([(word,)], "word STRING"), ["word"], "word").orderBy("i").collect()
    assert " ".join(r["key"] or "?" for r in t) == keys


def score(a, b):
    """Plain twin of the look-alike score."""
    conf = {frozenset(p) for p in X.CONFUSABLE}
    cap = [w[0] == w[0].upper() != w[0].lower() for w in (a, b)]
    if a == b or cap[0] != cap[1] or abs(len(a) - len(b)) > 1:
        return 0
    ends = 2 * (a[0].lower() == b[0].lower()) + 2 * (a[-1].lower() == b[-1].lower())
    if not ends:
        return 0
    if len(a) != len(b):
        return ends - 1
    return ends + sum(0 if x == y else 1 if frozenset((x, y)) in conf else -2 for x, y in zip(a.lower(), b.lower(), strict=True))


def test_lookalikes_against_all_pairs(spark):
    import itertools

    words = sorted({"".join(p) for p in itertools.product("enuhS", "aun", "emwklt", "nr")} | {"aus", "Haus", "Hans", "Maus", "ab", "a", "e", "nnnnnnn", "uuuuuuu", "nunununn"})
    df = spark.createDataFrame([(w,) for w in words], "word STRING")
    got = {}
    for r in Wd.best_lookalikes(df, df, 4).collect():
        got.setdefault(r["answer"], []).append((r["place"], r["candidate"], r["score"]))
    counts = {r["answer"]: r["plausible"] for r in Wd.plausible_counts(df, df).collect()}
    for a in words:
        ranked = sorted(((-score(a, b), b) for b in words if score(a, b) > 0))
        assert [(c, s) for _, c, s in sorted(got.get(a, []))] == [(b, -s) for s, b in ranked[:4]], a
        assert counts[a] == len(ranked)


def test_stroke_bounds(spark):
    cases = [
        (None, "no strokes"),
        ([], "no strokes"),
        ([[(0.0, 0.0)]], "stroke 0: points"),
        ([[(0.0, 0.0), (1.0, None)]], "stroke 0: coordinate"),
        ([[(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (101.0, 1.0)]], "stroke 1: range"),
        ([[(0.0, 0.0), (1.0, 1.0)]], None),
        ([[(0.0, 0.0), (1.0, 1.0)]] * 129, "too many strokes"),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i INT, s ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>")
    got = {r["i"]: r["p"] for r in df.select("i", Ch.stroke_violation(F.col("s")).alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(cases)}


def test_lone_excursion_is_repaired(spark):
    pts = [(i, 0.0) for i in range(10)]
    pts[4] = (4, 9.0)
    rows = [(1, 0, i, float(x), y) for i, (x, y) in enumerate(pts)]
    t = spark.createDataFrame(rows, "case_id BIGINT, stroke BIGINT, pos BIGINT, x DOUBLE, y DOUBLE")
    fixed = {r["pos"]: r for r in G.repaired(t).collect()}
    assert fixed[4]["repaired"] and (fixed[4]["x"], fixed[4]["y"]) == (4.0, 0.0)
    assert sum(r["repaired"] for r in fixed.values()) == 1
    assert G.spike_ratio(t, ["case_id"], ["case_id", "stroke"]).first()["spike_ratio"] == pytest.approx((1 + 81) ** 0.5)


def test_standing_then_jumping_is_infinite(spark):
    rows = [(1, 0, i, 0.0, 0.0) for i in range(5)] + [(1, 0, 5, 3.0, 0.0)]
    t = spark.createDataFrame(rows, "case_id BIGINT, stroke BIGINT, pos BIGINT, x DOUBLE, y DOUBLE")
    assert G.spike_ratio(t, ["case_id"], ["case_id", "stroke"]).first()["spike_ratio"] == float("inf")
