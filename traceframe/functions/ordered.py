"""Ordered operations along a dense position that never put a whole series into one task.

A series is cut into chunks of consecutive positions. Neighbours come from a window per chunk plus a halo of copied
edge rows; running totals and carried values come from a window per chunk plus one summary row per chunk. The summaries are taken from the already windowed rows: they
need no exchange of their own, and Spark reuses the one exchange for both sides of the join back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

CHUNK = 1 << 16


def _chunk(pos: str, chunk: int) -> Column:
    return F.floor(F.col(pos) / chunk).cast("bigint")


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    reach: int,
    columns: dict[str, Callable[[WindowSpec], Column]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Add window columns that look at most `reach` positions around: {name: function of the ordered window}."""
    inside = F.col(pos) % chunk
    home = _chunk(pos, chunk)
    copies = F.array_compact(
        F.array(
            home,
            F.when((inside < reach) & (home > 0), home - 1),
            F.when(inside >= chunk - reach, home + 1),
        )
    )
    w = Window.partitionBy(*keys, "_c").orderBy(pos)
    spread = df.withColumn("_home", home).withColumn("_c", F.explode(copies))
    spread = spread.select("*", *[fn(w).alias(name) for name, fn in columns.items()])
    return spread.where(F.col("_c") == F.col("_home")).drop("_c", "_home")


def neighbours(
    df: DataFrame, keys: Sequence[str], pos: str, wanted: dict[str, tuple[str, int]], chunk: int = CHUNK
) -> DataFrame:
    """Add columns from other positions: {name: (column, offset)}; null beyond the ends."""

    def at(column: str, offset: int) -> Callable[[WindowSpec], Column]:
        return lambda w: (F.lead(column, offset) if offset > 0 else F.lag(column, -offset)).over(w)

    reach = max(abs(o) for _, o in wanted.values())
    return windowed(df, keys, pos, reach, {n: at(c, o) for n, (c, o) in wanted.items()}, chunk)


def running_total(
    df: DataFrame, keys: Sequence[str], pos: str, totals: dict[str, Column | str], chunk: int = CHUNK
) -> DataFrame:
    """Add running sums up to and including each position: {name: value}; null values count as nothing."""
    cols = {n: (F.col(v) if isinstance(v, str) else v) for n, v in totals.items()}
    base = df.withColumn("_c", _chunk(pos, chunk))
    w = Window.partitionBy(*keys, "_c").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = base
    for name, value in cols.items():
        local = local.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))
    sums = local.groupBy(*keys, "_c").agg(*[F.max_by(n, pos).alias(f"_t_{n}") for n in cols])
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_c", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in cols]
    )
    out = local.join(offsets, [*keys, "_c"])
    for name in cols:
        out = out.withColumn(name, F.col(name) + F.col(f"_o_{name}"))
    return out.drop("_c", *[f"_o_{n}" for n in cols])


def running_max(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str, chunk: int = CHUNK
) -> DataFrame:
    """Add the largest value strictly before each position; null at the first."""
    base = df.withColumn("_c", _chunk(pos, chunk))
    w = Window.partitionBy(*keys, "_c").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumn("_l", F.max(value).over(w))
    tops = local.groupBy(*keys, "_c").agg(F.max(value).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_c", F.max("_m").over(before).alias("_m"))
    return local.join(tops, [*keys, "_c"]).withColumn(name, F.greatest("_l", "_m")).drop("_c", "_l", "_m")


def carried(
    df: DataFrame, keys: Sequence[str], pos: str, wanted: dict[str, str], backward: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """Add the last non-null value at or before each position (at or after when `backward`): {name: column}."""
    base = df.withColumn("_c", _chunk(pos, chunk))
    order = F.col(pos).desc() if backward else F.col(pos).asc()
    w = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = base
    for name, column in wanted.items():
        local = local.withColumn(name, F.last(column, ignorenulls=True).over(w))
    pick = F.min_by if backward else F.max_by
    ends = local.groupBy(*keys, "_c").agg(*[pick(n, pos).alias(f"_e_{n}") for n in wanted])
    corder = F.col("_c").desc() if backward else F.col("_c").asc()
    before = Window.partitionBy(*keys).orderBy(corder).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *keys, "_c", *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in wanted]
    )
    out = local.join(ends, [*keys, "_c"])
    for name in wanted:
        out = out.withColumn(name, F.coalesce(F.col(name), F.col(f"_p_{name}")))
    return out.drop("_c", *[f"_p_{n}" for n in wanted])


def dense_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, name: str = "pos", start: int = 0
) -> DataFrame:
    """Dense index of each row in its group. `bucket` must not decrease along `order` and must keep buckets small."""
    base = df.withColumn("__b", bucket)
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    numbered = base.withColumn("__r", F.row_number().over(w))
    counts = numbered.groupBy(*keys, "__b").agg(F.max("__r").alias("__k"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__b", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__o"))
    return (
        numbered.join(counts, [*keys, "__b"])
        .withColumn(name, F.col("__o") + F.col("__r") - 1 + start)
        .drop("__b", "__o", "__r")
    )


SPLITS = 255


def dense_rank_of(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "rank", descending: bool = False, start: int = 0
) -> DataFrame:
    """Dense index by (`value`, `tie`) inside each group, at any group size.

    Approximate quantiles of `value` cut a group into ranges; a value that equals a cut gets a range of its own,
    which is cut again by `tie`. Each range is numbered alone and shifted by the rows before it, so ranks are exact.
    Both columns must be numeric and not null; `tie` is unique in its group and ascending.
    """
    probs = [i / (SPLITS + 1) for i in range(1, SPLITS + 1)]
    v = (-F.col(value) if descending else F.col(value)).cast("double")
    base = df.withColumn("__v", v)
    groups = list(keys) or ["__all"]
    if not keys:
        base = base.withColumn("__all", F.lit(0))
    cuts = base.groupBy(*groups).agg(
        F.percentile_approx("__v", probs, 1000).alias("__s"),
        F.percentile_approx(F.col(tie), probs, 1000).alias("__ts"),
        F.count(F.lit(1)).alias("__n"),
    )
    # a group that fits one task is one range
    cut = F.when(F.col("__n") > CHUNK, F.array_distinct("__s")).otherwise(F.array().cast("array<double>"))
    cuts = cuts.withColumn("__s", cut).drop("__n")
    below = F.size(F.filter("__s", lambda s: s < F.col("__v")))
    on_cut = F.array_contains("__s", F.col("__v"))
    sub = F.when(on_cut, F.size(F.filter("__ts", lambda s: s < F.col(tie)))).otherwise(0)
    bucket = F.struct((below * 2 + on_cut.cast("int")).alias("b"), sub.alias("s"))
    ranked = dense_position(base.join(F.broadcast(cuts) if not keys else cuts, groups), groups, ["__v", tie], bucket, name, start)
    return ranked.drop("__v", "__s", "__ts", "__all")
