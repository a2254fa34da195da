"""Analysis of labelled rounds: reliability, occupancy, AUC, gates, places, drift and stratified building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.functions.ordered import dense_rank_of
from traceframe.functions.quantiles import exact_quantiles
from traceframe.functions.stats import hanley_mcneil_se
from traceframe.session import checkpointed
from traceframe.sources.readers import CODES, FINDINGS

MIN_POSITIVES = 8
MIN_REPEAT_POSITIVES = 3
EDGE = 3
ARGMAX_TOLERANCE = 4
HEAD, TAIL = 0.10, 0.90


def has(code: str | Column, codes: str = "codes") -> Column:
    return F.array_contains(F.col(codes), code)


def findings(codes: str = "codes") -> Column:
    return F.array_intersect(F.col(codes), F.array(*[F.lit(c) for c in FINDINGS]))


def shown(verdicts: DataFrame, key: DataFrame) -> DataFrame:
    """The pass proper: verdicts that are not a blind repeat, with their findings and flags."""
    repeats = key.where(F.col("repeat_of").isNotNull()).select("uid")
    return verdicts.join(repeats, "uid", "left_anti").withColumns(
        {
            "findings": findings(),
            "unratable": has("K"),
            "flagged": (F.size(findings()) > 0) | has("K"),
        }
    )


def _by_code(df: DataFrame, codes: Sequence[str], counts: dict[str, "object"]) -> DataFrame:
    """One output row per code from conditional counts over one scan; `counts` maps a name to a function of the code."""
    aggs = [fn(c).alias(f"{c}__{name}") for c in codes for name, fn in counts.items()]
    wide = df.agg(*aggs)
    rows = F.array(
        *[F.struct(F.lit(c).alias("code"), *[F.col(f"{c}__{n}").alias(n) for n in counts]) for c in codes]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def repeat_pairs(verdicts: DataFrame, key: DataFrame) -> DataFrame:
    """Each blind repeat with both readings; `missing` where one of them was not judged."""
    k = key.where(F.col("repeat_of").isNotNull()).select("uid", "repeat_of")
    a = verdicts.select(F.col("uid").alias("repeat_of"), F.col("codes").alias("a"))
    b = verdicts.select("uid", F.col("codes").alias("b"))
    j = k.join(a, "repeat_of", "left").join(b, "uid", "left")
    return j.withColumn("missing", F.col("a").isNull() | F.col("b").isNull())


def reliability(pairs: DataFrame) -> DataFrame:
    """Per code agreement of the repeats: yes, no, disagree, rate, band, too few positives."""
    p = pairs.where(~F.col("missing"))
    rows = _by_code(
        p,
        CODES,
        {
            "pairs": lambda c: F.count(F.lit(1)),
            "yes": lambda c: F.count_if(has(c, "a") & has(c, "b")),
            "no": lambda c: F.count_if(~has(c, "a") & ~has(c, "b")),
        },
    )
    agree = F.col("yes") + F.col("no")
    rate = F.when(F.col("pairs") > 0, agree / F.col("pairs"))
    disagree = F.col("pairs") - agree
    return rows.select(
        "code",
        "pairs",
        "yes",
        "no",
        disagree.alias("disagree"),
        (F.col("yes") + disagree).alias("carried"),
        rate.alias("rate"),
        F.when(rate >= 10 / 12, "reliable").when(rate <= 7 / 12, "coin flip").when(rate.isNotNull(), "middling").alias("band"),
        (F.col("yes") + disagree < MIN_REPEAT_POSITIVES).alias("too_few"),
    )


def exact_agreement(pairs: DataFrame) -> DataFrame:
    """Pairs, missing repeats and pairs whose code sets are equal."""
    same = F.array_sort("a") == F.array_sort("b")
    return pairs.agg(
        F.count_if(~F.col("missing")).alias("pairs"),
        F.count_if("missing").alias("missing"),
        F.count_if(~F.col("missing") & same).alias("exact"),
    )


def occupancy(pass_rows: DataFrame) -> DataFrame:
    """How often each code was set over the pass proper."""
    rows = _by_code(pass_rows, CODES, {"total": lambda c: F.count(F.lit(1)), "n": lambda c: F.count_if(has(c))})
    return rows.select("code", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).alias("share"), (F.col("n") < MIN_POSITIVES).alias("too_few"))


def occupancy_totals(pass_rows: DataFrame) -> DataFrame:
    """Totals of the pass: flagged, good with a finding, unsure, marked among the flagged."""
    g = pass_rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("flagged").alias("flagged"),
        F.count_if(has("G") & (F.size("findings") > 0)).alias("good_with_finding"),
        F.count_if(has("U")).alias("unsure"),
        F.count_if(F.col("flagged") & F.col("sx").isNotNull()).alias("marker_on_flagged"),
    )
    return g.withColumn("marker_rate", F.when(F.col("flagged") > 0, F.col("marker_on_flagged") / F.col("flagged")))


def verdict_sizes(pass_rows: DataFrame) -> DataFrame:
    """Histogram of the number of codes per verdict, modifiers not counted."""
    size = F.size(F.array_except("codes", F.array(F.lit("U"))))
    return pass_rows.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))


def finding_overlap(pass_rows: DataFrame) -> DataFrame:
    """Jaccard overlap of every pair of findings."""
    pairs = [(a, b) for i, a in enumerate(FINDINGS) for b in FINDINGS[i + 1 :]]
    aggs = []
    for a, b in pairs:
        aggs += [F.count_if(has(a) & has(b)).alias(f"{a}{b}_b"), F.count_if(has(a) | has(b)).alias(f"{a}{b}_u")]
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}{b}_b").alias("both"), F.col(f"{a}{b}_u").alias("union"))
            for a, b in pairs
        ]
    )
    out = pass_rows.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("share", F.when(F.col("union") > 0, F.col("both") / F.col("union")))


# ----------------------------------------------------------------- gates and AUC


def evaluated(pass_rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Ratable verdicts of the pass with their metrics."""
    return pass_rows.where(~F.col("unratable")).join(metrics, "uid", "left")


def gate_validation(pool: DataFrame, metric: str, op: str, threshold: float, category: str) -> DataFrame:
    """Precision and recall of `metric op threshold` against one category and against any finding."""
    m = F.col(metric)
    rejected = (m >= threshold) if op == ">=" else (m <= threshold)
    known = pool.where(m.isNotNull())
    targets = {category: has(category), "any finding": F.size("findings") > 0}
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("target"), F.col(f"p{i}").alias("positives"), F.col(f"c{i}").alias("caught"), F.col("rejected").alias("rejected"), F.col("evaluated").alias("evaluated"))
            for i, n in enumerate(targets)
        ]
    )
    aggs = [F.count(F.lit(1)).alias("evaluated"), F.count_if(rejected).alias("rejected")]
    for i, hit in enumerate(targets.values()):
        aggs += [F.count_if(hit).alias(f"p{i}"), F.count_if(hit & rejected).alias(f"c{i}")]
    out = known.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("precision", F.when(F.col("rejected") > 0, F.col("caught") / F.col("rejected"))).withColumn(
        "recall", F.when(F.col("positives") > 0, F.col("caught") / F.col("positives"))
    )


def missed_values(pool: DataFrame, metric: str, op: str, threshold: float, category: str) -> DataFrame:
    """Values of positives the gate let through, as counts per value."""
    m = F.col(metric)
    rejected = (m >= threshold) if op == ">=" else (m <= threshold)
    return pool.where(m.isNotNull() & has(category) & ~rejected).groupBy(m.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def rejected_verdicts(pool: DataFrame, metric: str, op: str, threshold: float) -> DataFrame:
    """What the rejected occurrences had been judged to be."""
    m = F.col(metric)
    rejected = (m >= threshold) if op == ">=" else (m <= threshold)
    name = F.when(F.size("findings") == 0, "-").otherwise(F.array_join("findings", ""))
    return pool.where(m.isNotNull() & rejected).groupBy(name.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def roc_auc(values: DataFrame, keys: Sequence[str], value: str, positive: str) -> DataFrame:
    """Area under the curve per key by mid-ranks; null when a side is empty.

    Equal values are counted first. A rank needs only the number of rows below a value, so each key is cut into value
    ranges by approximate quantiles: ranges are summed alone and shifted by the rows before them.
    """
    base = values.where(F.col(value).isNotNull())
    hist = base.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count_if(positive).cast("double").alias("_p"), F.count(F.lit(1)).cast("double").alias("_n")
    )
    probs = [i / 64 for i in range(1, 64)]
    cuts = base.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), probs, 1000).alias("_s"))
    h = hist.join(cuts, list(keys)) if keys else hist.join(F.broadcast(cuts), F.lit(True))
    h = h.withColumn("_b", F.size(F.filter("_s", lambda s: s < F.col("_v")))).drop("_s")
    sums = h.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(*keys, "_b", F.coalesce(F.sum("_bn").over(before), F.lit(0.0)).alias("_o"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = h.withColumn("_below", F.coalesce(F.sum("_n").over(inner), F.lit(0.0))).join(offs, [*keys, "_b"])
    mid = F.col("_o") + F.col("_below") + (F.col("_n") + 1) / 2
    g = ranked.groupBy(*keys).agg(F.sum(mid * F.col("_p")).alias("_r"), F.sum("_p").alias("n_pos"), (F.sum("_n") - F.sum("_p")).alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), (F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg")))
    out = g.select(*keys, auc.alias("auc"), F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"))
    return out.withColumn("se", hanley_mcneil_se(F.col("auc"), F.col("n_pos"), F.col("n_neg")))


def targets_of(unions: Sequence[Sequence[str]]) -> dict[str, Column]:
    """Named label targets: each finding, each union of findings, any finding."""
    out = {c: has(c) for c in FINDINGS}
    for group in unions:
        hit = F.lit(False)
        for c in group:
            hit = hit | has(c)
        out["∪".join(group)] = hit
    out["any"] = F.size("findings") > 0
    return out


def coverage_matrix(pool: DataFrame, metrics: Sequence[str | Column], unions: Sequence[Sequence[str]] = ()) -> DataFrame:
    """AUC, error and counts per metric and target; targets under 8 positives are named too few, without a number.

    `metrics` are column names or aliased expressions. One unpivoted pass feeds every cell.
    """
    cols = [(m, F.col(m)) if isinstance(m, str) else (m._jc.toString(), m) for m in metrics]
    targets = targets_of(unions)
    t = F.array(*[F.struct(F.lit(n).alias("target"), h.alias("hit")) for n, h in targets.items()])
    m = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("v")) for n, c in cols])
    long = pool.select("codes", "findings", m.alias("_m"), t.alias("_t"))
    positives = long.select(F.explode("_t").alias("t")).groupBy("t.target").agg(F.count_if("t.hit").alias("positives"))
    cells = long.select(F.explode("_m").alias("m"), "_t").select("m.*", F.explode("_t").alias("t")).select("metric", "v", "t.target", "t.hit")
    auc = roc_auc(cells, ["metric", "target"], "v", "hit")
    few = (F.col("target") != "any") & (F.col("positives") < MIN_POSITIVES)
    j = auc.join(positives, "target").withColumn("too_few", few)
    return j.select("metric", "target", F.when(~few, F.col("auc")).alias("auc"), F.when(~few, F.col("se")).alias("se"), "n_pos", "n_neg", "too_few")


def flag_rates(pool: DataFrame, flag: str, unions: Sequence[Sequence[str]] = ()) -> DataFrame:
    """For a boolean field: how many of each target and of the rest carry it."""
    known = pool.where(F.col(flag).isNotNull())
    targets = targets_of(unions)
    aggs = []
    for i, hit in enumerate(targets.values()):
        aggs += [F.count_if(hit & F.col(flag)).alias(f"s{i}"), F.count_if(hit).alias(f"p{i}"), F.count_if(~hit & F.col(flag)).alias(f"e{i}"), F.count_if(~hit).alias(f"n{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("target"), F.col(f"s{i}").alias("set"), F.col(f"p{i}").alias("n_pos"), F.col(f"e{i}").alias("set_elsewhere"), F.col(f"n{i}").alias("n_neg"))
            for i, n in enumerate(targets)
        ]
    )
    return known.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


# --------------------------------------------------------------- place and drift


def place_check(pass_rows: DataFrame, geometry: DataFrame) -> DataFrame:
    """Totals of the marked verdicts that have a place: hits near the metric's own maximum, at a boundary."""
    j = pass_rows.join(geometry, "uid", "left")
    marked = F.col("sx").isNotNull()
    usable = marked & F.coalesce("has_place", F.lit(False))
    return j.agg(
        F.count(F.lit(1)).alias("shown"),
        F.count_if(marked).alias("marked"),
        F.count_if(usable).alias("usable"),
        F.count_if(marked & ~usable).alias("without_geometry"),
        F.count_if(usable & (F.abs(F.col("idx") - F.col("argmax_idx")) <= ARGMAX_TOLERANCE)).alias("argmax_hits"),
        F.count_if(usable & (F.col("edge_dist") <= EDGE)).alias("at_boundary"),
        F.count_if(usable & (F.size("findings") == 1) & ~F.col("unratable")).alias("single_finding"),
    )


def place_per_category(pass_rows: DataFrame, geometry: DataFrame) -> DataFrame:
    """Head, middle, tail and boundary counts per finding, over marked verdicts with exactly one finding."""
    j = pass_rows.join(geometry.where("has_place"), "uid")
    single = j.where(F.col("sx").isNotNull() & (F.size("findings") == 1) & ~F.col("unratable"))
    rows = _by_code(
        single,
        FINDINGS,
        {
            "n": lambda c: F.count_if(has(c)),
            "head": lambda c: F.count_if(has(c) & (F.col("rel") < HEAD)),
            "tail": lambda c: F.count_if(has(c) & (F.col("rel") > TAIL)),
            "at_boundary": lambda c: F.count_if(has(c) & (F.col("edge_dist") <= EDGE)),
        },
    )
    return rows.withColumn("middle", F.col("n") - F.col("head") - F.col("tail")).withColumn("too_few", F.col("n") < MIN_POSITIVES)


def drift(pass_rows: DataFrame, blocks: int = 3) -> DataFrame:
    """Counts and median seconds per block of the sequence; block i starts at round-half-even(i n / blocks)."""
    ordered = dense_rank_of(pass_rows, [], "position", "position", "_k")
    n = pass_rows.agg(F.count(F.lit(1)).alias("_n"))
    j = ordered.join(F.broadcast(n), F.lit(True))
    block = F.lit(0)
    for i in range(1, blocks):
        block = block + (F.col("_k") >= F.bround(F.lit(float(i)) * F.col("_n") / blocks)).cast("int")
    j = j.withColumn("block", block)
    g = j.groupBy("block").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(has(c)).alias(f"n_{c}") for c in CODES],
        F.count_if(F.col("sx").isNotNull()).alias("marked"),
        F.count("seconds").alias("timed"),
    )
    return g.join(exact_quantiles(j, ["block"], "seconds", {"seconds_median": 0.5}), "block", "left")


def select_identities(judgements: DataFrame, identity: str, wanted: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Identities where any judgement carries all wanted codes, with their first judgement."""
    all_in = F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.col("codes"))) == 0
    g = judgements.groupBy(identity).agg(F.bool_or(all_in).alias("_hit"), F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n"))
    return g.where("_hit").select(identity, "first.*", "n")


# ---------------------------------------------------------- building a round


def stratified(rows: DataFrame, value: str, id_col: str, bands: int, n_label: int, shuffle_key: Column) -> DataFrame:
    """Deal rows across severity bands: rank worst first, cut into bands, shuffle inside a band by a seeded key, deal
    round robin. Any prefix spans all bands; the first `n_label` are the label set, the rest is the reserve."""
    # each ranking reads its input several times, so the chain is cut after the first one
    ranked = checkpointed(dense_rank_of(rows, [], value, id_col, "rank", descending=True))
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    j = ranked.join(F.broadcast(n), F.lit(True)).withColumn("_size", F.ceil(F.col("_n") / bands))
    j = j.withColumn("band", F.floor(F.col("rank") / F.col("_size")).cast("int")).withColumn("_h", shuffle_key)
    dealt = dense_rank_of(j, ["band"], "_h", id_col, "_turn")
    # rows dealt before: whole earlier rounds (only the last band can be short), then earlier bands of this round
    used = F.ceil(F.col("_n") / F.col("_size"))
    short = F.col("_n") - F.col("_size") * (used - 1)
    place = F.col("_turn") * (used - 1) + F.least(F.col("_turn"), short) + F.col("band")
    out = dealt.withColumn("place", place.cast("bigint"))
    out = out.withColumn("set", F.when(F.col("place") < n_label, "label").otherwise("reserve"))
    return checkpointed(out.drop("_n", "_size", "_h", "_turn"))


REPEAT_MIN_COUNT = 6
REPEAT_JITTER = 25


def picked_repeats(label: DataFrame, glyph: str, id_col: str, n_repeats: int, min_gap: int, exclude: Sequence[str], shuffle_key: Column) -> DataFrame:
    """Blind repeats: common glyphs only, early enough in the sequence, balanced across bands."""
    common = label.groupBy(glyph).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= REPEAT_MIN_COUNT)
    n = label.agg(F.count(F.lit(1)).alias("_n"))
    pool = (
        label.join(common, glyph, "left_semi")
        .where(~F.col(glyph).isin(list(exclude)))
        .join(F.broadcast(n), F.lit(True))
        .where(F.col("place") < F.col("_n") - min_gap - REPEAT_JITTER)
        .withColumn("_h", shuffle_key)
    )
    # at most n_repeats rows per band can be picked, so each task keeps that many
    w = Window.partitionBy("band").orderBy("_h", id_col)
    top = pool.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_repeats)
    return top.orderBy("_r", "band").limit(n_repeats).drop("_n", "_h")


def with_repeats(label: DataFrame, picks: DataFrame, id_col: str, min_gap: int, jitter: Column) -> DataFrame:
    """The finished sequence: every pick shown again at least `min_gap` places after its first showing.

    A repeat wants the place of its first showing plus gap plus jitter; it sorts in front of the row that holds it.
    """
    first = label.select(id_col, F.col("place").cast("double").alias("_at"), F.lit(None).cast("bigint").alias("first_place"))
    again = picks.select(
        id_col, (F.col("place") + min_gap + jitter - 0.5).alias("_at"), F.col("place").alias("first_place")
    )
    both = first.unionByName(again).withColumn("_tie", F.col(id_col))
    seq = dense_rank_of(both, [], "_at", "_tie", "sequence")
    return seq.drop("_at", "_tie")
