"""Exact grouped quantiles that stay exact and spread out when one group is huge.

`median()` keeps every distinct value of a group in one aggregation buffer. Here a mergeable sketch gives a bracket around each
wanted rank of every group, rows outside the bracket shrink to one counter by map-side combining, and only the bracket is
ordered. The bracket of a group of up to SMALL_GROUP values is the whole group. All groups go through the same plan, so no
group's answer depends on the others. The sketch never decides the answer: ranks are counted, so the result is exact.
A null key is a group like others. NaN counts as larger than every number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.operators.groups import by_rows

ACCURACY = 10_000
SMALL_GROUP = 50_000
EXACT_SKETCH = ACCURACY // 4


def _position(q: float, rule: str, n: Column) -> Column:
    """Zero-based position of quantile `q` among `n` ordered values."""
    if rule == "linear":
        return F.lit(q) * (n - 1)
    if rule == "half_up":
        return F.floor(F.lit(q) * (n - 1) + 0.5).cast("double")
    if rule == "half_even":
        return F.bround(F.lit(q) * (n - 1)).cast("double")
    if rule == "floor_n":
        return F.least(n - 1, F.floor(F.lit(q) * n)).cast("double")
    raise ValueError(f"unknown quantile rule {rule!r}")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `left` with the columns of `right` for the same keys; nulls equal each other."""
    for k in keys:
        right = right.withColumnRenamed(k, f"_of_{k}")
    if not keys:
        return left.crossJoin(right)
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(right, same).drop(*[f"_of_{k}" for k in keys])


def _of_small_groups(base: DataFrame, groups: Sequence[str], specs: Sequence[tuple[str, float, str]], count_name: str | None) -> DataFrame:
    """Quantiles of (groups, _v) by the place of each value in its group, which one task holds."""
    w = Window.partitionBy(*groups)
    ranked = base.withColumn("_at", F.row_number().over(w.orderBy("_v")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    picks, cols = [], []
    for i, (name, q, rule) in enumerate(specs):
        pos = _position(q, rule, F.col("_n").cast("double"))
        picks += [F.max(F.when(F.col("_at") == rank, F.col("_v"))).alias(f"_{tag}{i}") for tag, rank in (("l", F.floor(pos)), ("h", F.ceil(pos)))]
        cols.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (pos - F.floor(pos))).alias(name))
    out = ranked.groupBy(*groups).agg(F.max("_n").alias("_n"), *picks)
    return out.select(*groups, *cols, *([F.col("_n").alias(count_name)] if count_name else []))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    wanted: dict[str, float | tuple[float, str]],
    count_name: str | None = None,
    many: bool = False,
) -> DataFrame:
    """One row per key with the exact quantiles `wanted` = {column: q or (q, rule)}; nulls are ignored.

    `many`: of a great many groups nearly all are small. Those are ordered as they are, without a sketch for each; larger ones are
    counted out first, so `df` is read more than once and should be stored.

    Rules: `linear` interpolates, `half_up` / `half_even` pick the rounded rank of q(n-1), `floor_n` picks rank
    floor(q n). A null key is a group of its own; NaN is larger than every number.
    """
    specs = [(name, *(w if isinstance(w, tuple) else (float(w), "linear"))) for name, w in wanted.items()]
    value = F.col(value) if isinstance(value, str) else value
    groups = list(keys) or ["_all"]
    base = df.select(*(keys or [F.lit(0).alias("_all")]), value.cast("double").alias("_v")).where(
        F.col("_v").isNotNull()
    )
    if many:
        (few,), large = by_rows([base], groups, SMALL_GROUP)
        out = _of_small_groups(few, groups, specs, count_name).select(*keys, *[name for name, _, _ in specs], *([count_name] if count_name else []))
        return out if large is None else out.unionByName(exact_quantiles(large[0], keys, "_v", wanted, count_name))
    slack = 2.0 / ACCURACY
    ends = [e for _, q, _ in specs for e in (max(0.0, q - slack), min(1.0, q + slack))]
    place = F.nanvl("_v", F.lit(math.inf))
    sketch = base.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(place, ends, ACCURACY).alias("_s")
    )
    small = F.col("_n") <= max(SMALL_GROUP, EXACT_SKETCH)
    tags = []
    for i in range(len(specs)):
        kept = F.when(place >= F.col("_s")[2 * i], F.col("_v"))
        tags.append(F.when(place <= F.col("_s")[2 * i + 1], F.struct(F.lit(i).alias("q"), kept.alias("v"))))
    tagged = _null_safe_join(base, sketch, groups)
    whole = F.struct(F.lit(-1).alias("q"), F.col("_v").alias("v"))
    if len(specs) == 1:
        tagged = tagged.select(*groups, "_n", F.when(small, whole).otherwise(tags[0]).alias("_t")).where(F.col("_t").isNotNull())
    else:
        several = F.when(small, F.array(whole)).otherwise(F.array_compact(F.array(*tags)))
        tagged = tagged.select(*groups, "_n", F.explode(several).alias("_t"))
    hist = tagged.groupBy(*groups, F.col("_t.q").alias("_q"), F.col("_t.v").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n")
    )
    part = groups if len(specs) == 1 else [*groups, "_q"]
    w = Window.partitionBy(*part).orderBy(F.col("_v").asc_nulls_first())
    hist = hist.withColumn("_to", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.col("_n").cast("double")
    picks = []
    for i, (_, q, rule) in enumerate(specs):
        pos = _position(q, rule, n)
        for tag, rank in (("l", F.floor(pos)), ("h", F.ceil(pos))):
            hit = F.col("_q").isin(i, -1) & (F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}{i}"))
    out = hist.groupBy(*groups).agg(F.max("_n").alias("_n"), *picks)
    cols = []
    for i, (name, q, rule) in enumerate(specs):
        pos = _position(q, rule, n)
        cols.append(
            (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (pos - F.floor(pos))).alias(name)
        )
    if count_name:
        cols.append(F.col("_n").alias(count_name))
    return out.select(*keys, *cols)


def exact_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str = "_median") -> DataFrame:
    """Median of several columns per key, in one pass over an unpivoted copy."""
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("_u"),
    ).select(*keys, F.col("_u.m").alias("_m"), F.col("_u.v").alias("_x"))
    med = exact_quantiles(long, [*keys, "_m"], "_x", {"_med": 0.5})
    picks = [F.max(F.when(F.col("_m") == c, F.col("_med"))).alias(c + suffix) for c in columns]
    return med.groupBy(*keys).agg(*picks)


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str, names: tuple[str, str]) -> DataFrame:
    """Exact median and exact median absolute deviation per key."""
    base = df.select(*keys, F.col(value).cast("double").alias("_v"))
    med = exact_quantiles(base, keys, "_v", {names[0]: 0.5})
    dev = _null_safe_join(base, med, keys).select(*keys, names[0], F.abs(F.col("_v") - F.col(names[0])).alias("_dev"))
    return exact_quantiles(dev, [*keys, names[0]], "_dev", {names[1]: 0.5})
