"""Bench tables: summaries, paired comparison, exact tests, movement classes, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.functions.quantiles import exact_medians, exact_quantiles
from traceframe.functions.stats import binomial_two_sided

EPS = 1e-9
LOSER_GATE = -0.003


def one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side columns of frames that hold exactly one row each."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(F.broadcast(f.limit(1)), F.lit(True), "left")
    return out


def paired(a: DataFrame, b: DataFrame, on: Sequence[str], columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two runs; column c becomes a_c and b_c, plus which sides a row came from."""
    left = a.select(*on, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_a"))
    right = b.select(*on, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    j = left.join(right, list(on), how)
    side = (
        F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both").alias("side")
    )
    return j.select("*", side).drop("_a", "_b")


# ------------------------------------------------------------------- summaries


def run_summary(rows: DataFrame, keys: Sequence[str], medians: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Run block per key: counts, medians and p90 over scored rows, worst case, counter totals, seconds."""
    ok = F.col("status") == "ok"
    failed = F.col("status") == "failed"
    worst = F.struct(F.col("dtw_xh"), F.col("id"))
    block = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(ok).alias("scored"),
        F.count_if(failed).alias("failed"),
        F.count_if(~ok & ~failed).alias("skipped"),
        F.max(F.when(ok & F.col("dtw_xh").isNotNull(), worst)).alias("_worst"),
        *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in totals],
        F.count_if(ok & F.col("dtw_reversed_better")).alias("dtw_reversed_better"),
        F.count_if("marks_uncertain").alias("marks_uncertain"),
        F.coalesce(F.sum(F.when(ok, F.col("lift_delta"))), F.lit(0)).alias("lift_delta_total"),
        F.max(F.when(ok, F.col("dtw_max_absorption"))).alias("dtw_max_absorption_max"),
        F.sum(F.coalesce("secs", F.lit(0.0))).alias("secs"),
    )
    scored = rows.where(ok)
    med = exact_medians(scored, keys, medians)
    p90 = exact_quantiles(scored, keys, "dtw_xh", {"dtw_xh_p90": 0.9})
    return (
        block.join(med, list(keys), "left")
        .join(p90, list(keys), "left")
        .select("*", F.col("_worst.dtw_xh").alias("dtw_xh_worst"), F.col("_worst.id").alias("worst_id"))
        .drop("_worst")
    )


def sign_counts(deltas: DataFrame, keys: Sequence[str], delta: str, eps: float = EPS) -> DataFrame:
    """Two-sided exact sign test per key."""
    d = F.col(delta)
    g = deltas.where(d.isNotNull()).groupBy(*keys).agg(
        F.count_if(d > eps).alias("pos"), F.count_if(d < -eps).alias("neg"), F.count(F.lit(1)).alias("_all")
    )
    n = F.col("pos") + F.col("neg")
    return g.select(
        *keys,
        n.alias("n"),
        "pos",
        "neg",
        (F.col("_all") - n).alias("ties"),
        F.round(binomial_two_sided(F.least("pos", "neg"), n), 5).alias("p"),
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paired block over the cases both runs scored; every delta is b - a."""
    ok = F.col("status") == "ok"
    both = paired(a.where(ok), b.where(ok), ["id"], ["dtw_xh"], "full_outer")
    deltas = (
        both.where((F.col("side") == "both") & F.col("a_dtw_xh").isNotNull() & F.col("b_dtw_xh").isNotNull())
        .withColumn("delta", F.col("b_dtw_xh") - F.col("a_dtw_xh"))
        .withColumn("rel", F.when(F.col("a_dtw_xh") > 0, F.col("delta") / F.col("a_dtw_xh")))
    )
    counts = both.agg(
        F.count_if(F.col("side") == "both").alias("paired"), F.count_if(F.col("side") != "both").alias("unpaired")
    )
    q = exact_quantiles(deltas, [], "delta", {"delta_median": 0.5, "delta_p90": 0.9})
    rel = exact_quantiles(deltas, [], "rel", {"rel_median": 0.5})
    return one_row(counts, q, rel, sign_counts(deltas, [], "delta"))


def mcnemar(pairs: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Exact McNemar over boolean pairs: gained, lost and p (1 when nothing flipped)."""
    g = pairs.groupBy(*keys).agg(
        F.count_if(~F.col(before) & F.col(after)).alias("gained"),
        F.count_if(F.col(before) & ~F.col(after)).alias("lost"),
    )
    p = binomial_two_sided(F.least("gained", "lost"), F.col("gained") + F.col("lost"))
    return g.select(*keys, "gained", "lost", F.coalesce(p, F.lit(1.0)).alias("p"))


def relative_change(pairs: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Relative change per pair with a positive baseline: n, median %, p90 % by rank, worse and better counts."""
    rel = pairs.where(F.col(before) > 0).select(
        *keys, ((F.col(after) - F.col(before)) / F.col(before)).alias("_rel")
    )
    q = exact_quantiles(rel, keys, "_rel", {"_m": 0.5, "_p": (0.9, "floor_n")}, "n")
    c = rel.groupBy(*keys).agg(
        F.count_if(F.col("_rel") > 1e-12).alias("worse"), F.count_if(F.col("_rel") < -1e-12).alias("better")
    )
    j = q.join(c, list(keys)) if keys else one_row(q, c)
    return j.select(
        *keys, "n", (100.0 * F.col("_m")).alias("median_pct"), (100.0 * F.col("_p")).alias("p90_pct"), "worse", "better"
    )


def evaluate_arms(rows: DataFrame, base_weight: float, on: Sequence[str]) -> DataFrame:
    """Every arm against the baseline arm: benefit, costs, gate flips, medians. No baseline gives NaN or infinity."""
    fields = ["off_ink_share", "accepted", "geo_rmse_px", "cov_rmse_local_px", "iterations"]
    base = rows.where(F.col("weight") == base_weight).select(*on, *[F.col(c).alias(f"a_{c}") for c in fields])
    p = rows.select("weight", *on, *[F.col(c).alias(f"b_{c}") for c in fields]).join(base, list(on))
    w = ["weight"]
    main = p.groupBy("weight").agg(
        F.count(F.lit(1)).alias("n_occurrences"),
        F.avg("a_off_ink_share").alias("off_base"),
        F.avg("b_off_ink_share").alias("off_arm"),
        F.count_if("a_accepted").alias("accepted_base"),
        F.count_if("b_accepted").alias("accepted_arm"),
    )
    geo = relative_change(p, w, "a_geo_rmse_px", "b_geo_rmse_px").select(
        "weight", F.col("median_pct").alias("geo_median_pct"), F.col("p90_pct").alias("geo_p90_pct")
    )
    cov = relative_change(p, w, "a_cov_rmse_local_px", "b_cov_rmse_local_px").select(
        "weight", F.col("median_pct").alias("cov_median_pct")
    )
    flips = mcnemar(p, w, "a_accepted", "b_accepted")
    iters = exact_medians(p, w, ["a_iterations", "b_iterations"])
    own = rows.groupBy("weight").agg(
        F.count_if("hit_iteration_cap").alias("capped"), F.sum("n_stranded").alias("stranded")
    )
    spike = exact_quantiles(rows, w, "anchor_spike_ratio", {"spike_median": 0.5})
    j = main
    for part in (geo, cov, flips, iters, own, spike):
        j = j.join(part, "weight", "left")
    benefit = (
        F.when(F.col("off_base") > 0, 100.0 * (F.col("off_arm") - F.col("off_base")) / F.col("off_base"))
        .when(F.col("off_arm") > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("nan")))
    )

    def at_most(c: str, limit: float) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) <= limit

    cost_ok = (
        at_most("geo_median_pct", 5.0)
        & at_most("geo_p90_pct", 10.0)
        & at_most("cov_median_pct", 2.0)
        & (F.col("accepted_arm") >= F.col("accepted_base"))
        & ~((F.col("lost") > F.col("gained")) & (F.col("p") < 0.05))
    )
    j = j.withColumn("benefit_pct", benefit)
    return j.withColumn("benefit_ok", (F.col("benefit_pct") <= -25.0) & ~F.isnan("benefit_pct")).withColumn(
        "cost_ok", cost_ok
    )


def arm_pools(rows: DataFrame) -> DataFrame:
    """Medians per arm and pool (joined or final)."""
    pool = rows.where(F.col("gap_y").isNotNull()).withColumn("gap_abs", F.abs("gap_y"))
    keys = ["weight", "joined"]
    n = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return exact_medians(pool, keys, ["y_fit", "y_target", "gap_y", "gap_abs"]).join(n, keys)


def movement_medians(rows: DataFrame, base_weight: float, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Median movement of each field per arm against the baseline arm."""
    base = rows.where(F.col("weight") == base_weight).select(*on, *[F.col(c).alias(f"_a_{c}") for c in fields])
    p = rows.select("weight", *on, *fields).join(base, list(on))
    moved = p.select("weight", *[(F.col(c) - F.col(f"_a_{c}")).alias(f"d_{c}") for c in fields])
    return exact_medians(moved, ["weight"], [f"d_{c}" for c in fields])


def calibration(rows: DataFrame, solve: Sequence[str], order: str) -> DataFrame:
    """Energy ratio over baseline solves, one row per solve (the last in `order`): medians and ranked p10 / p90."""
    base = rows.where((F.col("weight") == 0.0) & (F.col("e_landmark") > 0))
    last = base.groupBy(*solve).agg(F.max_by(F.struct("e_geo", "e_landmark"), order).alias("_e")).select("_e.*")
    last = last.withColumn("ratio", F.col("e_geo") / F.col("e_landmark"))
    q = exact_quantiles(
        last,
        [],
        "ratio",
        {"ratio_median": 0.5, "ratio_p10": (0.10, "half_even"), "ratio_p90": (0.90, "half_even")},
        "n",
    )
    return one_row(
        q,
        exact_quantiles(last, [], "e_geo", {"e_geo_median": 0.5}),
        exact_quantiles(last, [], "e_landmark", {"e_landmark_median": 0.5}),
    )


def case_control(rows: DataFrame, flag: str, terms: Sequence[str]) -> DataFrame:
    """Median of each term for flagged and other rows."""
    long = rows.select(
        F.col(flag).alias("_f"),
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).cast("double").alias("v")) for t in terms])
        ).alias("_u"),
    ).select("_f", F.col("_u.term").alias("term"), F.col("_u.v").alias("v"))
    q = exact_quantiles(long, ["term", "_f"], "v", {"m": 0.5}, "n")
    return q.groupBy("term").agg(
        F.max(F.when(F.col("_f"), F.col("m"))).alias("case_median"),
        F.max(F.when(~F.col("_f"), F.col("m"))).alias("control_median"),
        F.max(F.when(F.col("_f"), F.col("n"))).alias("n_case"),
        F.max(F.when(~F.col("_f"), F.col("n"))).alias("n_control"),
    )


def spread(rows: DataFrame, keys: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """n, median, mean and p90 of a nullable column."""
    q = exact_quantiles(rows, keys, value, {"median": 0.5, "p90": 0.9}, "n")
    m = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"))
    j = q.join(m, list(keys)) if keys else one_row(q, m)
    return j.select(*keys, "n", *[F.round(c, digits).alias(c) for c in ("median", "mean", "p90")])


def paired_table(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """2x2 table of two booleans where both are known."""
    x, y = F.col(a), F.col(b)
    known = rows.where(x.isNotNull() & y.isNotNull())
    n = F.count(F.lit(1))
    return known.groupBy(*keys).agg(
        n.alias("n"),
        F.count_if(x & y).alias("both"),
        F.count_if(x & ~y).alias("only_a"),
        F.count_if(~x & y).alias("only_b"),
        F.count_if(~x & ~y).alias("neither"),
        F.round(F.count_if(x) / n, 3).alias("a_rate"),
        F.round(F.count_if(y) / n, 3).alias("b_rate"),
    )


COVERAGE_UNITS = 0.10
GEOMETRY_UNITS = 0.08


def gate_failures(rows: DataFrame, local: bool = False) -> DataFrame:
    """Why segments miss their gate: coverage, geometry, both or neither, with scale-dependent limits."""
    tail = "_local" if local else ""
    sides = [
        F.struct(
            F.col(f"chain_{t}_converged{tail}").alias("converged"),
            F.col(f"chain_{t}_geo_rmse_px").alias("geo"),
            F.col(f"chain_{t}_cov_rmse{tail}_px").alias("cov"),
        )
        for t in ("l", "r")
    ]
    long = rows.where(F.coalesce(F.col("xh_px"), F.lit(0.0)) != 0).select("xh_px", F.explode(F.array(*sides)).alias("s"))
    long = long.where(~F.coalesce(F.col("s.converged"), F.lit(True)))
    geo = F.coalesce(F.col("s.geo") > GEOMETRY_UNITS * F.col("xh_px"), F.lit(False))
    cov = F.coalesce(F.col("s.cov") > COVERAGE_UNITS * F.col("xh_px"), F.lit(False))
    return long.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(cov & ~geo).alias("cov_only"),
        F.count_if(geo & ~cov).alias("geo_only"),
        F.count_if(geo & cov).alias("both"),
        F.count_if(~geo & ~cov).alias("neither"),
    )


def per_key_rates(rows: DataFrame) -> DataFrame:
    """Rates per key; a row counts for its left and for its right key."""
    sides = [
        F.struct(
            F.col(f"chain_{t}_key").alias("key"),
            F.col(f"base_{ab}_converged").alias("base"),
            F.col(f"chain_{t}_converged").alias("chain"),
            F.coalesce(f"chain_{t}_converged_local", f"chain_{t}_converged").alias("local"),
        )
        for t, ab in (("l", "a"), ("r", "b"))
    ]
    long = rows.select(F.explode(F.array(*sides)).alias("s")).select("s.*")
    long = long.where((F.coalesce("key", F.lit("")) != "") & F.col("base").isNotNull() & F.col("chain").isNotNull())
    return long.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("base").alias("base"),
        F.count_if("chain").alias("chain"),
        F.count_if("local").alias("chain_local"),
    )


def gain_table(rows: DataFrame, keys: Sequence[str], had: str, got: str) -> DataFrame:
    """Of the rows with flag `had`, how many have flag `got`."""
    return rows.where(F.col(had)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(got), F.lit(False))).alias("gained")
    )


# ------------------------------------------------------------------- movements


def movement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Class of each case between two runs. Rows need id, status, target_dist, score and a comparable `content`."""
    j = paired(a, b, ["id"], ["status", "target_dist", "score", "content"], "full_outer")
    sa = F.coalesce("a_status", F.lit("missing"))
    sb = F.coalesce("b_status", F.lit("missing"))
    scored = (sa == "ok") & (sb == "ok")
    d = F.col("b_target_dist") - F.col("a_target_dist")
    score = F.col("b_score") - F.col("a_score")
    return j.select(
        "id",
        F.when(~scored & (sa != sb), "mismatched").when(~scored, "unscored").otherwise("scored").alias("state"),
        F.when(scored, F.when(d < 0, "better").when(d > 0, "worse").otherwise("same")).alias("target_class"),
        F.when(scored, F.when(F.col("a_content").eqNullSafe(F.col("b_content")), "identical").otherwise("moved")).alias(
            "content_class"
        ),
        F.when(scored, score).alias("score_delta"),
        F.when(scored, score < LOSER_GATE).alias("loser"),
    )


def penalised_block(rows: DataFrame, keys: Sequence[str], components: Sequence[str]) -> DataFrame:
    """Bench block where a failed case costs 1: mean loss, worst case, component means over scored cases."""
    loss = F.coalesce("loss", F.lit(1.0))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("loss").alias("n_scored"),
        F.avg(loss).alias("loss"),
        F.max(F.struct(loss.alias("l"), (-F.col("id")).alias("i"))).alias("_w"),
        *[F.avg(F.when(F.col("loss").isNotNull(), F.col(c))).alias(f"{c}_mean") for c in components],
    ).select("*", (-F.col("_w.i")).alias("worst_id"), F.col("_w.l").alias("worst_loss")).drop("_w")


def biggest_component_move(a: DataFrame, b: DataFrame, components: Sequence[str]) -> DataFrame:
    """Per case the component that moved most between two runs, with the signed move."""
    j = paired(a, b, ["id"], [*components, "loss"])
    moves = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col(f"b_{c}") - F.col(f"a_{c}")).isNotNull(),
                    F.struct(
                        F.abs(F.col(f"b_{c}") - F.col(f"a_{c}")).alias("size"),
                        F.lit(-i).alias("o"),
                        F.lit(c).alias("component"),
                        (F.col(f"b_{c}") - F.col(f"a_{c}")).alias("move"),
                    ),
                )
                for i, c in enumerate(components)
            ]
        )
    )
    top = F.array_max(moves)
    return j.select(
        "id",
        (F.col("b_loss") - F.col("a_loss")).alias("loss_delta"),
        top["component"].alias("component"),
        top["move"].alias("move"),
    )


def reason_rollup(rows: DataFrame, kind: str, gate: str) -> DataFrame:
    """Counts per (kind, gate) with the share inside the kind."""
    g = rows.groupBy(kind, gate).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(kind)))


def moved_summary(rows: DataFrame, shift: str, reason: str) -> DataFrame:
    """How many moved or were refused, and the median and largest shift of the moved only."""
    moved = rows.where(F.col(reason).isNull())
    c = rows.agg(
        F.count_if(F.col(reason).isNull()).alias("moved"),
        F.count_if(F.col(reason).isNotNull()).alias("refused"),
        F.max(F.when(F.col(reason).isNull(), F.col(shift))).alias("max_shift"),
    )
    return one_row(c, exact_quantiles(moved, [], shift, {"median_shift": 0.5}))


def badness(unfitted: Column, measures: Column) -> Column:
    """10 per unfitted item plus the mean of a map's values; an absent map counts nothing."""
    values = F.map_values(measures)
    mean = F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values)
    return 10.0 * unfitted + F.when(measures.isNotNull() & (F.size(values) > 0), mean).otherwise(0.0)


# --------------------------------------------------- joins of measured and made


def compare_joins(composed: DataFrame, measured: DataFrame, slots: DataFrame) -> DataFrame:
    """Outcome of each composed join against its measured occurrence.

    composed(case_id, from_slot, override, body_exit_x, body_entry_x, made_points), measured(case_id, slot, left_key,
    right_key, fit_ok, offset_x, points), slots(case_id, slot, key, next_key).
    """
    m = measured.withColumnRenamed("slot", "from_slot").withColumn("_m", F.lit(True))
    s = slots.withColumnRenamed("slot", "from_slot")
    j = composed.join(m, ["case_id", "from_slot"], "left").join(s, ["case_id", "from_slot"], "left")
    agree = (F.col("left_key") == F.col("key")) & (F.col("right_key") == F.col("next_key"))
    outcome = (
        F.when(F.coalesce("override", F.lit(False)), "excluded_override")
        .when(F.col("_m").isNull() | ~F.coalesce(agree, F.lit(False)), "unmatched")
        .when(~F.coalesce("fit_ok", F.lit(False)), "excluded_fit")
        .when(F.col("body_exit_x").isNull() | F.col("body_entry_x").isNull(), "unmatched")
        .when((F.size("made_points") < 2) | (F.size("points") < 2), "unmatched")
        .otherwise("matched")
    )
    j = j.withColumn("outcome", outcome)
    doff = F.round(F.abs(F.col("body_entry_x") - F.col("body_exit_x") - F.col("offset_x")), 3)
    return j.withColumn("doff", F.when(F.col("outcome") == "matched", doff)).drop("_m")


# ---------------------------------------------------------------- set operations


def content_dedupe(rows: DataFrame, content: Sequence[str], id_col: str) -> DataFrame:
    """One row per content digest: the first id, how many ids it covers and how many were dropped."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    g = rows.select(id_col, digest.alias("digest")).groupBy("digest")
    return g.agg(F.min(id_col).alias("kept"), F.count(F.lit(1)).alias("covered")).withColumn(
        "dropped", F.col("covered") - 1
    )


def covered_keys(rows: DataFrame, content: Sequence[str], id_col: str) -> DataFrame:
    """(kept, covered): every id beside the first id with the same content, itself included; no list of a group is built."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    keyed = rows.select(F.col(id_col).alias("covered"), digest.alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("covered").alias("kept"))
    return keyed.join(first, "digest").select("kept", "covered")


def merged_boxes(rows: DataFrame, keys: Sequence[str], priority: Sequence[str], locked: str) -> DataFrame:
    """One row per key, the first by `priority`; it is locked if any of the rows was."""
    rest = [c for c in rows.columns if c not in (*keys, locked)]
    g = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*priority)).alias("_b"), F.bool_or(F.coalesce(F.col(locked), F.lit(False))).alias(locked))
    return g.select(*keys, "_b.*", locked)


def collapse_siblings(rows: DataFrame, keys: Sequence[str], priority: str, content: str, variant: str) -> DataFrame:
    """Collapse rows that fall on one key: the best priority keeps its variant, equal content goes away, different
    content moves to the next free variants after the highest stored one."""
    w = Window.partitionBy(*keys, content).orderBy(priority, variant)
    first = rows.withColumn("_d", F.row_number().over(w)).where(F.col("_d") == 1).drop("_d")
    # one row per (key, content) is left: a key has a handful of variants
    k = Window.partitionBy(*keys)
    ranked = first.withColumn("_r", F.row_number().over(k.orderBy(priority, variant))).withColumn(
        "_top", F.max(variant).over(k)
    )
    return ranked.withColumn(
        "new_variant", F.when(F.col("_r") == 1, F.col(variant)).otherwise(F.col("_top") + F.col("_r") - 1)
    ).drop("_r", "_top")


def manifest_order(rows: DataFrame, manifest: DataFrame, key: str, pos: str) -> DataFrame:
    """Rank for sorting: manifest rank first, keys outside it afterwards in their own order."""
    m = manifest.select(F.col(key), F.col("rank").alias("_rank"))
    j = rows.join(m, key, "left")
    return j.withColumn(
        "order_key", F.struct(F.col("_rank").isNull().cast("int").alias("o"), F.coalesce("_rank", F.col(pos)).alias("p"))
    ).drop("_rank")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows in an explicit order (each task keeps n rows)."""
    return df.orderBy(*order).limit(n)


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per group in an explicit order; the cap is the feature."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
