"""Spatial joins and order-dependent matching.

Proximity and intersection joins meet on grid cells. Matching that depends on an order is decided in chunks of consecutive
rows of bounded size, in rounds that end when no chunk changes its decisions. Rounds are checkpointed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.functions.quantiles import exact_quantiles
from traceframe.operators.cases import close_pairs, nearest_rows
from traceframe.operators.groups import by_rows, solved_groups
from traceframe.session import checkpointed

#: Rows of both sides up to which the points of a key are compared in one task, and pairs compared there at once.
ROWS_OF_KEY, PAIRS_AT_ONCE = 1 << 12, 1 << 20


def near_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], radius: float | Column, in_task: int = ROWS_OF_KEY) -> DataFrame:
    """All pairs with the same keys within `radius`; columns become a_* and b_*, plus dist. Both sides hold x, y.

    Keys of up to `in_task` rows of both sides are compared in one task, many keys together; larger ones meet on grid cells. The
    sides are read more than once and should be stored.
    """
    same = a is b
    # what can have no partner: null keys and places that are null, NaN or infinite
    some = " AND ".join([*(f"`{k}` IS NOT NULL" for k in keys), *(f"abs({c}) < double('infinity')" for c in ("x", "y"))])
    a, b = (df.where(some) for df in (a, b))
    if isinstance(radius, Column):
        return _pairs_on_grid(a, b, keys, radius)
    small, large = by_rows([a, b], keys, in_task)
    near = _pairs_in_task(*small, keys, radius, same)
    return near if large is None else near.unionByName(_pairs_on_grid(*large, keys, radius))


def _within(pairs: DataFrame, radius: float | Column) -> DataFrame:
    """Pairs with their distance, up to `radius`."""
    dist = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    return pairs.withColumn("dist", dist).where(F.col("dist") <= radius)


def _sided(df: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])


def _pairs_on_grid(a: DataFrame, b: DataFrame, keys: Sequence[str], radius: float | Column) -> DataFrame:
    """The same for keys of any size: a point meets those of the nine cells around it."""
    cell = F.lit(radius) if not isinstance(radius, Column) else radius

    def cells(df: DataFrame, p: str) -> DataFrame:
        renamed = _sided(df, keys, p)
        return renamed.withColumn("_cx", F.floor(F.col(f"{p}_x") / cell)).withColumn("_cy", F.floor(F.col(f"{p}_y") / cell))

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = cells(b, "b").withColumn("_o", F.explode(around))
    right = right.withColumn("_cx", F.col("_cx") + F.col("_o.i")).withColumn("_cy", F.col("_cy") + F.col("_o.j")).drop("_o")
    return _within(cells(a, "a").join(right, [*keys, "_cx", "_cy"]), cell).drop("_cx", "_cy")


def _pairs_in_task(a: DataFrame, b: DataFrame, keys: Sequence[str], radius: float, same: bool = False) -> DataFrame:
    """The same with all rows of a key in one task: a row meets those whose x is near. `same`: both sides are `a`, which is sent once."""
    a, b = (df.withColumns({c: F.col(c).cast("double") for c in ("x", "y")}) for df in (a, b))
    sides = {p: [c for c in df.columns if c not in keys] for p, df in (("a", a), ("b", b))}
    own = {p: {f"{p}_{c}": c if same else f"{p}_{c}" for c in columns} for p, columns in sides.items()}
    if same:
        rows, order = a, ["x"]
    else:
        left, right = _sided(a, keys, "a").withColumn("_side", F.lit(1)), _sided(b, keys, "b").withColumn("_side", F.lit(0))
        rows, order = left.unionByName(right, allowMissingColumns=True), ["_side", F.coalesce("a_x", "b_x")]

    def solve(table: pa.Table, first: np.ndarray) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        ends = np.append(first[1:], table.num_rows)
        of = np.repeat(np.arange(len(first)), ends - first)
        if same:
            x, y = (table[c].to_numpy() for c in ("x", "y"))
            left = right = np.arange(table.num_rows)
            begin, stop = first[of], ends[of]
        else:
            side = table["_side"].to_numpy()
            x, y = (np.where(side == 1, table[f"a_{c}"].to_numpy(), table[f"b_{c}"].to_numpy()) for c in ("x", "y"))
            left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
            begin, stop = first[of[left]], (ends - np.add.reduceat(side, first))[of[left]]
        # groups one after the other on a line, so that one search finds the rows with a near x; the right side leads its group
        width = float(x.max() - x.min()) + 2 * radius + 1
        line = of * width + (x - x.min())
        slack = radius + 1e-9 * width * (len(first) + 1)
        rank = lambda want, how: np.append(right, table.num_rows)[np.searchsorted(line[right], want, side=how)]
        lo = np.clip(rank(line[left] - slack, "left"), begin, stop)
        hi = np.clip(rank(line[left] + slack, "right"), lo, stop)
        total = np.cumsum(hi - lo)
        at = 0
        while at < len(left):
            done = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, side="right")))
            some = (hi - lo)[at:to]
            l = np.repeat(left[at:to], some)
            r = np.arange(len(l)) + np.repeat(lo[at:to] - np.cumsum(some) + some, some)
            # a little wider than asked: the distance itself decides afterwards
            near = np.hypot(x[l] - x[r], y[l] - y[r]) <= radius * (1 + 1e-9)
            rows_of = {"a": pa.array(l[near], pa.int64()), "b": pa.array(r[near], pa.int64())}
            yield rows_of["a"], {name: table[c].take(rows_of[p]) for p in own for name, c in own[p].items()}
            at = to

    extra = ", ".join(f"`{p}_{c}` {df.schema[c].dataType.simpleString()}" for p, df in (("a", a), ("b", b)) for c in sides[p])
    return _within(solved_groups(rows, keys, order, solve, extra), radius)


def adjacent_slots(rows: DataFrame, word: Sequence[str], slot: str, joins: str, boxes: Sequence[str]) -> DataFrame:
    """Slot i with slot i+1 of the same word when both join: keys and the union of both boxes (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = boxes
    nxt = rows.where(joins).select(*word, (F.col(slot) - 1).alias(slot), F.col("key").alias("right_key"), *[F.col(c).alias(f"_{c}") for c in boxes])
    j = rows.where(joins).join(nxt, [*word, slot])
    return j.select(
        *word,
        slot,
        F.col("key").alias("left_key"),
        "right_key",
        F.least(x0, f"_{x0}").alias("x0"),
        F.least(y0, f"_{y0}").alias("y0"),
        F.greatest(x1, f"_{x1}").alias("x1"),
        F.greatest(y1, f"_{y1}").alias("y1"),
    )


def nearest_unique(points: DataFrame, candidates: DataFrame, keys: Sequence[str], id_col: str, radius: float, margin: float) -> DataFrame:
    """Per point the one candidate within `radius`; refused as ambiguous when the second nearest is closer than `margin`
    to the nearest distance, no_candidate when none is near. Candidates hold cand, x, y."""
    near = near_pairs(points, candidates, keys, radius + margin)
    order = Window.partitionBy(*keys, f"a_{id_col}").orderBy("dist", "b_cand")
    two = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2)
    g = two.groupBy(*keys, f"a_{id_col}").agg(
        F.min("dist").alias("d1"),
        F.max(F.when(F.col("_r") == 2, F.col("dist"))).alias("d2"),
        F.max(F.when(F.col("_r") == 1, F.col("b_cand"))).alias("cand"),
    ).withColumnRenamed(f"a_{id_col}", id_col)
    j = points.select(*keys, id_col).join(g, [*keys, id_col], "left")
    reason = (
        F.when(F.col("d1").isNull() | (F.col("d1") > radius), "no_candidate")
        .when(F.col("d2") - F.col("d1") < margin, "ambiguous")
        .otherwise("ok")
    )
    j = j.withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    return j.select(*keys, id_col, "reason", F.when(ok, F.col("cand")).alias("cand"), F.when(ok, F.col("d1")).alias("dist"))


#: Rows that one task decides in order.
ROWS_IN_TASK = 50_000


def _in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """`rows` with `_at`, a number that grows along `order` within the keys: rows are sorted over all partitions, at any group size."""
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return checkpointed(ordered.withColumn("_at", F.monotonically_increasing_id()))


def _in_chunks(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int, whole: str | None = None) -> DataFrame:
    """`rows` with `_chunk`, consecutive runs along `order` of about `limit` rows; a group up to `limit` is chunk 0 as a whole.

    Rows with equal `whole`, which leads the order, stay together.
    """
    rows = checkpointed(rows)
    (small,), large = by_rows([rows], keys, limit)
    small = small.withColumn("_chunk", F.lit(0).cast("bigint"))
    if large is None:
        return small
    ordered = _in_order(large[0], keys, order)
    part = F.shiftright(F.col("_at"), 33)
    first = ordered.groupBy(*keys, part.alias("_p")).agg(F.min("_at").alias("_first"))
    j = ordered.withColumn("_p", part).join(first, [*keys, "_p"])
    run = F.floor((F.col("_at") - F.col("_first")) / limit)
    j = j.withColumn("_chunk", ((F.col("_p") + 1) * F.lit(1 << 32) + run).cast("bigint")).drop("_p", "_first", "_at")
    if whole is not None:
        least = j.groupBy(*keys, whole).agg(F.min("_chunk").alias("_least"))
        j = j.join(least, [*keys, whole]).withColumn("_chunk", F.col("_least")).drop("_least")
    return checkpointed(small.unionByName(j))


def _decided(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    told: Callable[[DataFrame, DataFrame | None], DataFrame],
    solve: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, dict[str, pa.Array]]],
    extra: str,
) -> DataFrame:
    """Decisions of a rule that goes through `rows` in order, where each one depends on those before it.

    A chunk is decided in one task, with what `told` adds to its rows about the decisions of earlier chunks: none at first, then
    those of the round before. When a round changes nothing, each chunk has seen what the ones before it decided, so the
    result is that of the plain order. After round k the first k chunks are right: rounds end, usually after two or three.
    Groups of one chunk are right at once; many small ones are decided together.
    """
    names = [*keys, "_chunk"]

    def round_of(part: DataFrame, before: DataFrame | None) -> DataFrame:
        return checkpointed(solved_groups(told(part, before), names, order, solve, extra))

    now = round_of(rows, None)
    several = checkpointed(rows.where("_chunk > 0").select(*keys).distinct())
    if several.isEmpty():
        return now
    settled = now.join(several, list(keys), "left_anti")
    rest = checkpointed(rows.join(several, list(keys), "left_semi"))
    now = checkpointed(now.join(several, list(keys), "left_semi"))
    while True:
        new = round_of(rest, now)
        same = new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty()
        now = new
        if same:
            return settled.unionByName(now)


def _spans(table: pa.Table, first: np.ndarray) -> list[tuple[int, int]]:
    """Rows of each group, from and up to."""
    cuts = [*first.tolist(), table.num_rows]
    return list(zip(cuts[:-1], cuts[1:]))


def _claims(picks: DataFrame, keys: Sequence[str], side: str, name: str) -> DataFrame:
    """First chunk that took each point of a side."""
    return picks.where(F.col(side).isNotNull()).groupBy(*keys, F.col(side).alias(name)).agg(F.min("_chunk").alias("_by"))


def _free(part: DataFrame, before: DataFrame | None, keys: Sequence[str], sides: dict[str, str]) -> DataFrame:
    """Rows whose points are not taken by an earlier chunk."""
    for name, side in sides.items() if before is not None else ():
        part = part.join(_claims(before, keys, side, name), [*keys, name], "left")
        part = part.where(F.coalesce(F.col("_by") >= F.col("_chunk"), F.lit(True))).drop("_by")
    return part


def greedy_one_to_one(ref: DataFrame, cand: DataFrame, keys: Sequence[str], radius: float, limit: int = ROWS_IN_TASK) -> DataFrame:
    """Greedy one-to-one matches by ascending (distance, ref, cand) under a radius: (keys, ref, cand, dist).

    Keys of few rows are matched many in a task; pairs of larger ones are decided in chunks of `limit`. Both sides are read more
    than once and should be stored.
    """
    ref, cand = (df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, name, "x", "y") for df, name in ((ref, "ref"), (cand, "cand")))
    small, large = by_rows([ref, cand], keys, min(ROWS_OF_KEY, limit))
    near = _greedy_in_task(*small, keys, radius)
    return near if large is None else near.unionByName(_greedy_in_chunks(*(checkpointed(df) for df in large), keys, radius, limit))


def _greedy_in_task(ref: DataFrame, cand: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """The same with all rows of a key in one task; its pairs stay there."""
    sides = ((ref, "ref", 0), (cand, "cand", 1))
    left, right = (
        df.select(*keys, F.lit(side).alias("_side"), F.col(name).alias(f"_{name}"), *[F.col(c).cast("double").alias(c) for c in ("x", "y")])
        for df, name, side in sides
    )

    def solve(table: pa.Table, first: np.ndarray) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        side, x, y = (table[c].to_numpy() for c in ("_side", "x", "y"))
        ends = np.append(first[1:], table.num_rows)
        of = np.repeat(np.arange(len(first)), ends - first)
        right = np.add.reduceat(side, first)
        most = np.cumsum((ends - first - right) * right)
        # rows of a key with one id are one point; rows stand in order of ids, so that counting them gives their rank
        ids = []
        for name in ("_ref", "_cand"):
            code = table[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            new = np.ones(len(code), dtype=bool)
            new[1:] = (code[1:] != code[:-1]) | (side[1:] != side[:-1]) | (of[1:] != of[:-1])
            ids.append(np.cumsum(new) - 1)
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(most, (int(most[at - 1]) if at else 0) + PAIRS_AT_ONCE, side="right")))
            lo, hi = first[at], ends[to - 1]
            found = [np.zeros((2, 0), dtype=np.int64)]
            for a, b in close_pairs(of[lo:hi], x[lo:hi], y[lo:hi], radius):
                apart = side[lo + a] != side[lo + b]
                a, b = lo + a[apart], lo + b[apart]
                a, b = np.where(side[a] == 0, a, b), np.where(side[a] == 0, b, a)
                near = np.hypot(x[a] - x[b], y[a] - y[b]) <= radius
                found.append(np.stack([a[near], b[near]]))
            a, b = np.concatenate(found, axis=1)
            dist = np.hypot(x[a] - x[b], y[a] - y[b])
            order = np.lexsort((ids[1][b], ids[0][a], dist))
            a, b, dist = a[order], b[order], dist[order]
            taken = bytearray(table.num_rows), bytearray(table.num_rows)
            picked = []
            for k, (p, q) in enumerate(zip(ids[0][a].tolist(), ids[1][b].tolist())):
                if not taken[0][p] and not taken[1][q]:
                    taken[0][p] = taken[1][q] = 1
                    picked.append(k)
            own, other = pa.array(a[picked], pa.int64()), pa.array(b[picked], pa.int64())
            yield own, {"ref": table["_ref"].take(own), "cand": table["_cand"].take(other), "dist": pa.array(dist[picked], pa.float64())}
            at = to

    extra = f"ref {dict(ref.dtypes)['ref']}, cand {dict(cand.dtypes)['cand']}, dist double"
    return solved_groups(left.unionByName(right, allowMissingColumns=True), keys, ["_side", "_ref", "_cand"], solve, extra)


def _greedy_in_chunks(ref: DataFrame, cand: DataFrame, keys: Sequence[str], radius: float, limit: int) -> DataFrame:
    """The same for keys of any size: pairs are rows, cut along their order."""
    pairs = near_pairs(ref, cand, keys, radius).select(*keys, F.col("a_ref").alias("_l"), F.col("b_cand").alias("_r"), "dist")
    rows = _in_chunks(pairs, keys, ["dist", "_l", "_r"], limit)

    def solve(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        left, right = table["_l"].to_pylist(), table["_r"].to_pylist()
        picked = []
        for start, stop in _spans(table, first):
            taken_l, taken_r = set(), set()
            for k in range(start, stop):
                if left[k] not in taken_l and right[k] not in taken_r:
                    taken_l.add(left[k])
                    taken_r.add(right[k])
                    picked.append(k)
        at = pa.array(picked, pa.int64())
        return at, {name: table[c].take(at) for name, c in (("ref", "_l"), ("cand", "_r"), ("dist", "dist"))}

    types = dict(rows.dtypes)
    told = lambda part, before: _free(part, before, keys, {"_l": "ref", "_r": "cand"})
    return _decided(rows, keys, ["dist", "_l", "_r"], told, solve, f"ref {types['_l']}, cand {types['_r']}, dist double").drop("_chunk")


def sequential_matches(ref: DataFrame, cand: DataFrame, keys: Sequence[str], radius: float, margin: float, limit: int = ROWS_IN_TASK) -> DataFrame:
    """Reference points in order of `ref` each take the nearest free candidate or refuse: (keys, ref, reason, cand, dist)."""
    near = near_pairs(ref, cand, keys, radius + margin).where(F.col("a_ref").isNotNull())
    pairs = near.select(*keys, F.col("a_ref").alias("_l"), F.col("b_cand").alias("_r"), "dist")
    rows = _in_chunks(pairs, keys, ["_l", "dist", "_r"], limit, "_l")
    types = dict(rows.dtypes)

    def solve(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        left, right, dist = (table[c].to_pylist() for c in ("_l", "_r", "dist"))
        at, reasons, chosen = [], [], []
        for start, stop in _spans(table, first):
            claimed = set()
            while start < stop:
                end = start + 1
                while end < stop and left[end] == left[start]:
                    end += 1
                free = [k for k in range(start, end) if right[k] not in claimed]
                reason, pick = "ok", None
                if not free or dist[free[0]] > radius:
                    reason = "no_candidate"
                elif len(free) > 1 and dist[free[1]] - dist[free[0]] < margin:
                    reason = "ambiguous"
                else:
                    pick = free[0]
                    claimed.add(right[pick])
                at.append(start)
                reasons.append(reason)
                chosen.append(pick)
                start = end
        own, pick = pa.array(at, pa.int64()), pa.array(chosen, pa.int64())
        return own, {
            "ref": table["_l"].take(own), "reason": pa.array(reasons, pa.string()), "cand": table["_r"].take(pick), "dist": table["dist"].take(pick)
        }

    told = lambda part, before: _free(part, before, keys, {"_r": "cand"})
    done = _decided(rows, keys, ["_l", "dist", "_r"], told, solve, f"ref {types['_l']}, reason string, cand {types['_r']}, dist double").drop("_chunk")
    j = ref.select(*keys, "ref").join(done, [*keys, "ref"], "left")
    return j.select(*keys, "ref", F.coalesce("reason", F.lit("no_candidate")).alias("reason"), "cand", "dist")


def match_counts(ref: DataFrame, cand: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ref, cand, matched, missing, spurious, ambiguous and median error per key."""
    hits = matches.where(F.col("dist").isNotNull())
    amb = F.count_if(F.col("reason") == "ambiguous") if "reason" in matches.columns else F.lit(0)
    m = matches.groupBy(*keys).agg(F.count("dist").alias("matched"), F.max(F.lit(0)).alias("_z"), amb.alias("ambiguous") if "reason" in matches.columns else F.max(F.lit(0)).alias("ambiguous"))
    med = exact_quantiles(hits, keys, "dist", {"median_error": 0.5})
    n = ref.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ref")).join(cand.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cand")), list(keys), "full_outer")
    z = F.lit(0).cast("bigint")
    j = n.join(m, list(keys), "left").join(med, list(keys), "left")
    matched = F.coalesce("matched", z)
    return j.select(
        *keys,
        F.coalesce("n_ref", z).alias("ref"),
        F.coalesce("n_cand", z).alias("cand"),
        matched.alias("matched"),
        (F.coalesce("n_ref", z) - matched).alias("missing"),
        (F.coalesce("n_cand", z) - matched).alias("spurious"),
        F.coalesce("ambiguous", z).cast("bigint").alias("ambiguous"),
        "median_error",
    )


def suppressed(points: DataFrame, keys: Sequence[str], id_col: str, priority: Sequence[Column], radius: float, limit: int = ROWS_IN_TASK) -> DataFrame:
    """Keep the best point, drop its neighbours within `radius`, go on: the kept rows. Priority ends with a unique id."""
    ranked = _in_order(points.withColumn("_rank", F.struct(*priority)), keys, ["_rank"]).drop("_rank")
    p = ranked.select(*keys, F.col("_at").alias("no"), "x", "y")
    near = near_pairs(p, p, keys, radius).where(F.col("a_no") < F.col("b_no"))
    pairs = near.select(*keys, F.col("a_no").alias("_l"), F.col("b_no").alias("_r"))
    rows = _in_chunks(pairs, keys, ["_r", "_l"], limit, "_r")

    def solve(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        better, worse, gone = (table[c].to_pylist() for c in ("_l", "_r", "gone"))
        at, flags = [], []
        for start, stop in _spans(table, first):
            lost: dict[int, bool] = {}
            for k in range(start, stop):
                if worse[k] not in lost:
                    at.append(k)
                lost[worse[k]] = lost.get(worse[k], False) or not lost.get(better[k], gone[k])
            flags += lost.values()
        own = pa.array(at, pa.int64())
        return own, {"no": table["_r"].take(own), "lost": pa.array(flags, pa.bool_())}

    def told(part: DataFrame, before: DataFrame | None) -> DataFrame:
        """What an earlier chunk decided on the better point; its own chunk decides anew."""
        if before is None:
            return part.withColumn("gone", F.lit(False))
        known = before.where("lost").select(*keys, F.col("no").alias("_l"), F.lit(True).alias("gone"))
        return part.join(known, [*keys, "_l"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))

    lost = _decided(rows, keys, ["_r", "_l"], told, solve, "no bigint, lost boolean").where("lost")
    return ranked.join(lost.select(*keys, F.col("no").alias("_at")), [*keys, "_at"], "left_anti").select(*points.columns)


# ------------------------------------------------------------- proximity in a trace


def trace_samples(trace: DataFrame) -> DataFrame:
    """Trace with arc inside its stroke, unit tangents and a dense index `idx` along the case."""
    from traceframe.functions.ordered import dense_position
    from traceframe.operators.geometry import STROKE, tangents
    from traceframe.operators.resample import with_arc

    t = tangents(with_arc(trace, STROKE)).drop("step")
    return dense_position(t, ["case_id"], ["pos"], F.col("stroke"), "idx")


def other_pass(samples: DataFrame, prox: float, arc_factor: float = 3.0) -> DataFrame:
    """Pairs of samples of one case within `prox` that belong to different passes, with |cross| and dot of the tangents."""
    s = samples.select("case_id", "idx", "stroke", "pos", "arc", "x", "y", "tx", "ty")
    p = near_pairs(s, s, ["case_id"], prox).where(F.col("a_idx") != F.col("b_idx"))
    p = p.where((F.col("a_stroke") != F.col("b_stroke")) | (F.abs(F.col("a_arc") - F.col("b_arc")) > arc_factor * prox))
    return p.withColumn("cross", F.abs(F.col("a_tx") * F.col("b_ty") - F.col("a_ty") * F.col("b_tx"))).withColumn(
        "dot", F.col("a_tx") * F.col("b_tx") + F.col("a_ty") * F.col("b_ty")
    )


def retrace_partners(samples: DataFrame, prox: float, max_angle: float = 25.0) -> DataFrame:
    """Nearest anti-parallel partner of each sample: (case_id, idx, stroke, pos, partner, partner_stroke)."""
    p = other_pass(samples, prox).where((F.col("cross") <= F.sin(F.radians(F.lit(max_angle)))) & (F.col("dot") < 0))
    best = p.groupBy("case_id", "a_idx").agg(
        F.min(F.struct("dist", "b_idx", "b_stroke")).alias("m"), F.max("a_stroke").alias("stroke"), F.max("a_pos").alias("pos")
    )
    return best.select("case_id", F.col("a_idx").alias("idx"), "stroke", "pos", F.col("m.b_idx").alias("partner"), F.col("m.b_stroke").alias("partner_stroke"))


def crossing_passages(samples: DataFrame, prox: float, min_angle: float = 25.0) -> DataFrame:
    """Runs of samples where another pass goes across: stroke, first and last position, partner index at the middle."""
    from traceframe.operators.geometry import islands

    p = other_pass(samples, prox).where(F.col("cross") > F.sin(F.radians(F.lit(min_angle))))
    hit = p.groupBy("case_id", "a_idx").agg(F.min("b_idx").alias("partner")).withColumnRenamed("a_idx", "idx")
    t = samples.join(hit, ["case_id", "idx"], "left").withColumn("hot", F.col("partner").isNotNull())
    runs = islands(t.select("case_id", "stroke", "pos", "hot"), ["case_id", "stroke"], "pos", "hot")
    mid = runs.withColumn("pos", F.floor((F.col("start") + F.col("end")) / 2))
    return mid.join(t.select("case_id", "stroke", "pos", "partner"), ["case_id", "stroke", "pos"]).drop("pos", "n")


def doubled_pairs(samples: DataFrame, nib: float, low: float, arc_apart: float = 0.22, parallel: float = 22.0) -> DataFrame:
    """Samples whose line runs beside another pass: perpendicular offset in (low, 1.35 nib), nearly parallel."""
    reach = 1.35 * nib
    s = samples.select("case_id", "idx", "stroke", "pos", "arc", "x", "y", "tx", "ty")
    p = near_pairs(s, s, ["case_id"], reach).where(F.col("a_idx") != F.col("b_idx"))
    p = p.where((F.col("a_stroke") != F.col("b_stroke")) | (F.abs(F.col("a_arc") - F.col("b_arc")) > arc_apart))
    perp = F.abs(F.col("a_tx") * (F.col("b_y") - F.col("a_y")) - F.col("a_ty") * (F.col("b_x") - F.col("a_x")))
    cross = F.abs(F.col("a_tx") * F.col("b_ty") - F.col("a_ty") * F.col("b_tx"))
    return p.withColumn("perp", perp).where((F.col("perp") > low) & (F.col("perp") < reach) & (cross < F.sin(F.radians(F.lit(parallel)))))


MIN_CHORD = 1e-9


def self_intersections(segs: DataFrame, cell: float, min_gap: int = 2) -> DataFrame:
    """Proper intersections of the segments of one case: parameters in [0, 1), no neighbours inside one stroke.

    segs(case_id, stroke, pos, idx, x0, y0, x1, y1, arc): idx orders the segments of a case, arc is the arc at the start.
    A segment is put into every cell its box touches; a pair counts in the cell of its boxes' common lower corner.
    """
    s = segs.withColumns(
        {
            "lx": F.least("x0", "x1"), "hx": F.greatest("x0", "x1"), "ly": F.least("y0", "y1"), "hy": F.greatest("y0", "y1"),
            "len": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")),
        }
    ).where(F.col("len") >= MIN_CHORD)

    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))

    cells = s.withColumn("_cx", F.explode(span("lx", "hx"))).withColumn("_cy", F.explode(span("ly", "hy")))

    def side(p: str) -> DataFrame:
        return cells.select("case_id", "_cx", "_cy", *[F.col(c).alias(f"{p}_{c}") for c in s.columns if c != "case_id"])

    j = side("a").join(side("b"), ["case_id", "_cx", "_cy"])
    same = F.col("a_stroke") == F.col("b_stroke")
    overlap = (F.col("a_hx") >= F.col("b_lx")) & (F.col("b_hx") >= F.col("a_lx")) & (F.col("a_hy") >= F.col("b_ly")) & (F.col("b_hy") >= F.col("a_ly"))
    home = (F.col("_cx") == F.floor(F.greatest("a_lx", "b_lx") / cell)) & (F.col("_cy") == F.floor(F.greatest("a_ly", "b_ly") / cell))
    j = j.where((F.col("a_idx") < F.col("b_idx")) & home & overlap & (~same | (F.col("b_pos") - F.col("a_pos") >= min_gap)))
    rx, ry = F.col("a_x1") - F.col("a_x0"), F.col("a_y1") - F.col("a_y0")
    sx, sy = F.col("b_x1") - F.col("b_x0"), F.col("b_y1") - F.col("b_y0")
    qx, qy = F.col("b_x0") - F.col("a_x0"), F.col("b_y0") - F.col("a_y0")
    den = rx * sy - ry * sx
    j = j.withColumn("_den", den).where(F.abs("_den") >= MIN_CHORD)
    j = j.withColumn("ta", (qx * sy - qy * sx) / F.col("_den")).withColumn("tb", (qx * ry - qy * rx) / F.col("_den"))
    j = j.where((F.col("ta") >= 0) & (F.col("ta") < 1) & (F.col("tb") >= 0) & (F.col("tb") < 1))
    cos = F.abs(rx * sx + ry * sy) / (F.col("a_len") * F.col("b_len"))
    sep = F.abs(F.col("b_arc") + F.col("tb") * F.col("b_len") - F.col("a_arc") - F.col("ta") * F.col("a_len"))
    return j.select(
        "case_id",
        F.col("a_idx").alias("seg_i"),
        F.col("b_idx").alias("seg_j"),
        F.col("a_stroke").alias("stroke_i"),
        F.col("a_pos").alias("pos_i"),
        F.col("b_stroke").alias("stroke_j"),
        F.col("b_pos").alias("pos_j"),
        (F.col("a_x0") + F.col("ta") * rx).alias("x"),
        (F.col("a_y0") + F.col("ta") * ry).alias("y"),
        F.degrees(F.acos(F.least(F.lit(1.0), cos))).alias("angle"),
        F.when(same, sep).otherwise(F.lit(float("inf"))).alias("separation"),
    )


def trace_segments(samples: DataFrame) -> DataFrame:
    """Segments of sampled traces for `self_intersections`."""
    from traceframe.functions.ordered import neighbours

    n = neighbours(samples, ["case_id", "stroke"], "pos", {"x1": ("x", 1), "y1": ("y", 1)}).where(F.col("x1").isNotNull())
    return n.select("case_id", "stroke", "pos", "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1", "arc")


# ---------------------------------------------------------------- nearest neighbours


#: Rows that share a cell of the grid in the first round, about.
ROWS_OF_CELL = 4


def _point_distance(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    return np.hypot(a["x"] - b["x"], a["y"] - b["y"])


def _least(
    a: dict[str, np.ndarray], b: dict[str, np.ndarray], first: np.ndarray, size: np.ndarray, distance: Callable[[dict, dict], np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `a` the least distance to its `size` rows of `b` from `first` on, and the first of those that have it."""
    least, owner = np.empty(len(first)), np.empty(len(first), dtype=np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(first):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        some = size[lo:hi]
        begin = np.concatenate([[0], np.cumsum(some)[:-1]])
        which = np.repeat(np.arange(hi - lo), some)
        at = np.arange(len(which)) + (first[lo:hi] - begin)[which]
        gap = distance({k: v[lo:hi][which] for k, v in a.items()}, {k: v[at] for k, v in b.items()})
        gap[np.isnan(gap)] = np.inf
        least[lo:hi] = np.minimum.reduceat(gap, begin)
        hit = np.flatnonzero(gap == least[lo:hi][which])
        owner[lo:hi] = at[hit[np.append(True, np.diff(which[hit]) > 0)]]
        lo = hi
    return least, owner


def _near_in_task(a: DataFrame, b: DataFrame, keys: Sequence[str], owner: str | None, columns: Sequence[str], distance: Callable[[dict, dict], np.ndarray]) -> DataFrame:
    """The nearest row of `b` for each row of `a`, all rows of a key in one task; `columns` of `b` are what `distance` reads."""
    rest = [c for c in a.columns if c not in keys]
    own = F.col(owner) if owner else F.lit(None).cast("int")
    left = a.select(*keys, F.lit(0).alias("_side"), *[F.col(c).alias(f"a_{c}") for c in rest])
    right = b.select(*keys, F.lit(1).alias("_side"), own.alias("_owner"), *[F.col(c).alias(f"b_{c}") for c in columns])

    def solve(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        side = table["_side"].to_numpy()
        m = np.add.reduceat(side, first)
        n = np.diff(np.append(first, table.num_rows)) - m
        m = np.where(n > 0, m, 0)
        n = np.where(m > 0, n, 0)
        which = np.repeat(np.arange(len(first)), n)
        at = np.arange(len(which)) + (first - np.cumsum(n) + n)[which]
        read = lambda name: table[name].to_numpy().astype(float)
        points = {c: read(f"a_{c}")[at] for c in ("x", "y")}
        others = {c: read(f"b_{c}") for c in columns}
        least, nearest = np.full(len(at), np.inf), np.full(len(at), -1)
        if distance is _point_distance:
            there = np.flatnonzero(side == 1)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
            least, row = nearest_rows(which, points["x"], points["y"], of[there], *(others[c][there] for c in columns))
            nearest = np.where(row >= 0, there[row], -1)
        left = np.flatnonzero(nearest < 0)
        of_left = which[left]
        least[left], nearest[left] = _least({c: v[left] for c, v in points.items()}, others, (first + n)[of_left], m[of_left], distance)
        found = pa.array(at, pa.int64())
        out = {c: table[f"a_{c}"].take(found) for c in rest} | {"dist": pa.array(least, mask=np.isinf(least))}
        return at, out | ({owner: table["_owner"].take(pa.array(nearest, pa.int64()))} if owner else {})

    types = [f"`{c}` {a.schema[c].dataType.simpleString()}" for c in rest] + ["dist double"]
    types += [f"`{owner}` {b.schema[owner].dataType.simpleString()}"] if owner else []
    return solved_groups(left.unionByName(right, allowMissingColumns=True), keys, ["_side", "_owner"], solve, ", ".join(types))


def nearest_distances(
    a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float, owner: str | None = None, in_task: int = ROWS_OF_KEY
) -> DataFrame:
    """Distance of each row of `a` to the nearest row of `b` with the same keys: a's columns, dist (and the owner).

    Keys of up to `in_task` rows of both sides are compared in one task, many keys together; larger ones meet on grid cells.
    Ties go to the smaller owner. Keys without any `b` row are left out.
    """
    a, b = (df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))) for df in (a, b))
    small, large = by_rows([a, b], keys, in_task)
    near = _near_in_task(*small, keys, owner, ("x", "y"), _point_distance)
    return near if large is None else near.unionByName(_near_on_grid(*large, keys, cell, owner))


def _near_on_grid(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float, owner: str | None) -> DataFrame:
    """The same in rounds: a point is settled when something lies within one cell around it; the others go on with cells twice as wide.

    Where cells of the given width are crowded, rounds begin with smaller ones, so that a point meets a few others and not its whole key.
    """
    rest = [c for c in a.columns if c not in keys]
    todo = checkpointed(a.join(b.select(*keys).distinct(), list(keys), "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    b = checkpointed(b)
    out = None
    crowd = b.groupBy(*keys, F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)).agg(F.count(F.lit(1)).alias("_n"))
    # rows that share a cell, on average over rows; halving the width leaves a quarter of them
    shared = crowd.agg((F.sum(F.col("_n") * F.col("_n").cast("double")) / F.sum("_n")).alias("_n")).first()["_n"] or 1.0
    size = cell / 2 ** max(0, math.ceil(math.log2(shared / ROWS_OF_CELL) / 2))
    while True:
        hits = _pairs_on_grid(todo, b, keys, size)
        pick = F.min_by(f"b_{owner}", F.struct("dist", f"b_{owner}")) if owner else F.lit(None)
        g = hits.groupBy(*keys, "a__row").agg(F.min("dist").alias("dist"), *([pick.alias(owner)] if owner else []))
        found = checkpointed(todo.join(g.withColumnRenamed("a__row", "_row"), [*keys, "_row"]))
        out = found if out is None else out.unionByName(found)
        todo = checkpointed(todo.join(found.select("_row"), "_row", "left_anti"))
        if todo.isEmpty():
            return out.select(*keys, *rest, "dist", *([owner] if owner else []))
        size *= 2


def _segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment, which may be a point."""
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / square))).otherwise(0.0)
    return F.hypot(px - (x0 + t * dx), py - (y0 + t * dy))


def _segment_cells(segs: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Segments once for each cell that they run through: column by column, the rows between the heights at its sides."""
    lx, hx = F.least("x0", "x1"), F.greatest("x0", "x1")
    s = segs.withColumn("_cx", F.explode(F.sequence(F.floor(lx / size), F.floor(hx / size))))
    slope = F.when(hx > lx, (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    at = lambda x: F.col("y0") + slope * (x - F.col("x0"))
    a, b = at(F.greatest(lx, F.col("_cx") * size)), at(F.least(hx, (F.col("_cx") + 1) * size))
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    # a little wider than computed, so that rounding leaves no cell out
    slack = size * 1e-6
    y_lo = F.when(slope.isNull(), low).otherwise(F.greatest(low, F.least(a, b) - slack))
    y_hi = F.when(slope.isNull(), high).otherwise(F.least(high, F.greatest(a, b) + slack))
    return s.withColumn("_cy", F.explode(F.sequence(F.floor(y_lo / size), F.floor(y_hi / size))))


_SEGMENT = ("x0", "y0", "x1", "y1")


def _distance_to_segment(p: dict[str, np.ndarray], s: dict[str, np.ndarray]) -> np.ndarray:
    dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
    square = dx * dx + dy * dy
    along = (p["x"] - s["x0"]) * dx + (p["y"] - s["y0"]) * dy
    t = np.clip(np.divide(along, square, out=np.zeros_like(along), where=square > 0), 0.0, 1.0)
    return np.hypot(p["x"] - (s["x0"] + t * dx), p["y"] - (s["y0"] + t * dy))


def nearest_segments(points: DataFrame, segs: DataFrame, keys: Sequence[str], cell: float, in_task: int = ROWS_OF_KEY) -> DataFrame:
    """Exact distance of each point to the nearest segment of the same keys: its columns, dist and the segment's `owner`.

    segs(keys, owner, x0, y0, x1, y1); a segment may be a point. Keys of up to `in_task` rows of both sides are compared in one task,
    many keys together; larger ones meet on grid cells. Ties go to the smaller owner. Keys without a segment are left out.
    """
    points, segs = (df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))) for df in (points, segs))
    small, large = by_rows([points, segs], keys, in_task)
    near = _near_in_task(*small, keys, "owner", _SEGMENT, _distance_to_segment)
    return near if large is None else near.unionByName(_segments_on_grid(*large, keys, cell))


def _segments_on_grid(points: DataFrame, segs: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """The same in rounds: a segment within one cell width of a point runs through one of the nine cells around it, so such a point is
    settled; the others go on with cells twice as wide."""
    rest = [c for c in points.columns if c not in keys]
    held = checkpointed(segs.select(*keys, "owner", "x0", "y0", "x1", "y1"))
    todo = checkpointed(points.join(held.select(*keys).distinct(), list(keys), "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    out, size = None, cell
    while True:
        cells = _segment_cells(held, keys, size)
        p = todo.select(*keys, "_row", F.col("x").alias("_x"), F.col("y").alias("_y"), around.alias("_o"))
        p = p.withColumn("_cx", F.floor(F.col("_x") / size) + F.col("_o.i")).withColumn("_cy", F.floor(F.col("_y") / size) + F.col("_o.j"))
        d = _segment_distance(F.col("_x"), F.col("_y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
        near = p.join(cells, [*keys, "_cx", "_cy"]).withColumn("dist", d).where(F.col("dist") <= size)
        best = near.groupBy(*keys, "_row").agg(F.min(F.struct("dist", "owner")).alias("_b"))
        found = checkpointed(todo.join(best.select(*keys, "_row", "_b.dist", "_b.owner"), [*keys, "_row"]))
        out = found if out is None else out.unionByName(found)
        todo = checkpointed(todo.join(found.select("_row"), "_row", "left_anti"))
        if todo.isEmpty():
            return out.select(*keys, *rest, "dist", "owner")
        size *= 2


#: Bands of a key up to which they travel in one row.
BANDS_IN_ROW = 1 << 10


def assigned_to_bands(comps: DataFrame, bands: DataFrame, keys: Sequence[str], reach: float, in_row: int = BANDS_IN_ROW) -> DataFrame:
    """Band of each component: the largest overlap (ties to the later band), else the nearest band that starts below its
    centre within `reach`, else null. comps(id, y0, y1), bands(band, b0, b1).

    Up to `in_row` bands of a key come as one row, so that a component meets them once; those of other keys are joined one by one.
    """

    def gaps(b0: Column, b1: Column) -> tuple[Column, Column]:
        return F.least(F.col("y1"), b1) - F.greatest(F.col("y0"), b0), b0 - (F.col("y0") + F.col("y1")) / 2

    band = F.when(F.col("_o.o") > 0, F.col("_o.b")).when(F.col("_n.d") <= reach, F.col("_n.b")).alias("band")
    (few,), large = by_rows([bands], keys, in_row)

    def over(b: Column) -> Column:
        return F.struct(gaps(b["b0"], b["b1"])[0].alias("o"), b["band"].alias("b"))

    def under(b: Column) -> Column:
        return F.struct(gaps(b["b0"], b["b1"])[1].alias("d"), b["band"].alias("b"))

    lists = few.groupBy(*keys).agg(F.collect_list(F.struct("band", "b0", "b1")).alias("_b"))
    rest = comps if large is None else comps.join(large[0].select(*keys).distinct(), list(keys), "left_anti")
    below = F.filter(F.transform("_b", under), lambda n: n["d"] >= 0)
    near = rest.join(lists, list(keys), "left").select(*comps.columns, F.array_max(F.transform("_b", over)).alias("_o"), F.array_min(below).alias("_n"))
    out = near.select(*comps.columns, band)
    if large is None:
        return out
    o, n = gaps(F.col("b0"), F.col("b1"))
    g = comps.join(large[0], list(keys)).groupBy(*keys, "id").agg(
        F.max(F.struct(o.alias("o"), F.col("band").alias("b"))).alias("_o"), F.min(F.when(n >= 0, F.struct(n.alias("d"), F.col("band").alias("b")))).alias("_n")
    )
    many = comps.join(g.select(*keys, "id", band), [*keys, "id"])
    return out.unionByName(many)


def overlapping_boxes(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float, pad: float = 0.0) -> DataFrame:
    """Pairs of overlapping boxes (b grown by `pad`) with the clipped box: a_id, b_id, x0, y0, x1, y1 and both areas."""

    def cells(df: DataFrame, p: str, grow: float) -> DataFrame:
        d = df.select(*keys, F.col("id").alias(f"{p}_id"), (F.col("x0") - grow).alias(f"{p}x0"), (F.col("y0") - grow).alias(f"{p}y0"), (F.col("x1") + grow).alias(f"{p}x1"), (F.col("y1") + grow).alias(f"{p}y1"))
        d = d.withColumn("_cx", F.explode(F.sequence(F.floor(F.col(f"{p}x0") / cell), F.floor(F.col(f"{p}x1") / cell))))
        return d.withColumn("_cy", F.explode(F.sequence(F.floor(F.col(f"{p}y0") / cell), F.floor(F.col(f"{p}y1") / cell))))

    j = cells(a, "a", 0.0).join(cells(b, "b", pad), [*keys, "_cx", "_cy"])
    j = j.withColumns({"x0": F.greatest("ax0", "bx0"), "y0": F.greatest("ay0", "by0"), "x1": F.least("ax1", "bx1"), "y1": F.least("ay1", "by1")})
    home = (F.col("_cx") == F.floor(F.col("x0") / cell)) & (F.col("_cy") == F.floor(F.col("y0") / cell))
    j = j.where(home & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))

    def area(p: str) -> Column:
        return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))

    inter = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return j.select(*keys, "a_id", "b_id", "x0", "y0", "x1", "y1", (inter / (area("a") + area("b") - inter)).alias("iou"))


# -------------------------------------------------------------- connected components


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Smallest reachable node id per node: (node, component). edges(a, b) are undirected; ids must be comparable.

    Every round takes the smallest label among the neighbours and then follows labels of labels, so the number of rounds
    grows with the logarithm of the longest path.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(nodes.select(F.col(node).alias("n"), F.col(node).alias("l")))
    while True:
        seen = both.join(labels, both.b == labels.n).groupBy("a").agg(F.min("l").alias("m"))
        # hook the root as well, so that whole trees merge at once
        low = labels.join(seen, labels.n == seen.a, "left").select("n", "l", F.least("l", F.coalesce("m", "l")).alias("m"))
        root = low.groupBy(F.col("l").alias("n")).agg(F.min("m").alias("rm"))
        hooked = low.join(root, "n", "left").select("n", "l", F.least("m", F.coalesce("rm", "m")).alias("m"))
        hooked = checkpointed(hooked)
        up = hooked.select(F.col("n").alias("m"), F.col("m").alias("mm"))
        new = checkpointed(hooked.join(up, "m", "left").select("n", F.col("l").alias("old"), F.least("m", "mm").alias("l")))
        changed = not new.where(F.col("old") != F.col("l")).isEmpty()
        labels = new.select("n", "l")
        if not changed:
            return labels.select(F.col("n").alias(node), F.col("l").alias("component"))


#: Side of the square tiles in which pixels are joined at once.
PIXEL_TILE = 256


def _joined_pixels(group: np.ndarray, x: np.ndarray, y: np.ndarray, diagonal: bool) -> np.ndarray:
    """First row of the component of each row, for pixels in order of (group, x, y)."""
    n = len(x)
    new = np.ones(n, dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (x[1:] != x[:-1])
    line, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    heights = np.unique(y)
    code = line * len(heights) + np.searchsorted(heights, y)
    gap = y[1:] - y[:-1]
    below = np.flatnonzero(~new[1:] & ((gap == 0) | (gap == 1)))
    a, b = [below], [below + 1]
    beside = np.append((group[begin[1:]] == group[begin[:-1]]) & (x[begin[1:]] == x[begin[:-1]] + 1), False)
    at = np.flatnonzero(beside[line])
    for dy in (-1, 0, 1) if diagonal else (0,):
        want = y[at] + dy
        rank = np.minimum(np.searchsorted(heights, want), len(heights) - 1)
        key = (line[at] + 1) * len(heights) + rank
        to = np.minimum(np.searchsorted(code, key), n - 1)
        hit = (heights[rank] == want) & (code[to] == key)
        a.append(at[hit])
        b.append(to[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def pixel_components(pixels: DataFrame, keys: Sequence[str], diagonal: bool = False, keep: Sequence[str] = (), tile: int = PIXEL_TILE) -> DataFrame:
    """Pixels (keys, x, y) with the id of their connected component, the least (keys, x, y) in it, and the columns `keep`.

    Pixels of a tile are joined in one task, many tiles at once; what is left are the components that go on across a border. The
    rows are stored.
    """
    names = [*keys, "x", "y"]
    inside = [*keys, "_tx", "_ty"]
    place = lambda c: F.floor(c / tile)
    p = pixels.select(*names, *keep).withColumns({"_tx": place(F.col("x")), "_ty": place(F.col("y"))})
    kinds = dict(p.dtypes)

    def solve(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        known = np.logical_and.reduce([table[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False) for c in names])
        some = np.flatnonzero(known)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        root = np.arange(table.num_rows)
        if len(some):
            x, y = (table[c].take(pa.array(some)).to_numpy() for c in ("x", "y"))
            root[some] = some[_joined_pixels(group[some], x, y, diagonal)]
        of = pa.array(root)
        columns = {c: table[c] for c in ("x", "y", *keep)} | {"_rx": table["x"].take(of), "_ry": table["y"].take(of)}
        return np.arange(table.num_rows), columns

    extra = ", ".join(f"`{c}` {kinds[c]}" for c in ("x", "y", *keep)) + f", _rx {kinds['x']}, _ry {kinds['y']}"
    local = checkpointed(solved_groups(p, inside, ["x", "y"], solve, extra))
    local = local.withColumn("_id", F.struct(*keys, F.col("_rx").alias("x"), F.col("_ry").alias("y")))

    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if diagonal else [])
    leaves = lambda dx, dy: (place(F.col("x") + dx) != F.col("_tx")) | (place(F.col("y") + dy) != F.col("_ty"))
    moves = F.filter(
        F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), leaves(dx, dy).alias("out")) for dx, dy in steps]), lambda m: m["out"]
    )
    edge = leaves(1, 0) | leaves(0, 1) | leaves(0, -1)
    over = local.where(edge).select(*keys, F.explode(moves).alias("_m"), F.col("_id").alias("a")).select(*keys, "_m.x", "_m.y", "a")
    there = local.where(leaves(-1, 0) | edge).select(*names, F.col("_id").alias("b"))
    edges = checkpointed(over.join(there, names).select("a", "b").distinct())
    if edges.isEmpty():
        return local.select(*names, *keep, F.col("_id").alias("component"))
    ends = edges.select(F.col("a").alias("_id")).union(edges.select("b")).distinct()
    c = connected_components(ends, edges, "_id")
    return local.join(c, "_id", "left").select(*names, *keep, F.coalesce("component", "_id").alias("component"))


def component_boxes(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box (upper ends exclusive) and area per component."""
    return labelled.groupBy(*keys, "component").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count(F.lit(1)).alias("area")
    )


def kept_by_size(labelled: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Pixels of components with at least `least` pixels."""
    big = labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return labelled.join(big, [*keys, "component"], "left_semi")


def without_excluded(labelled: DataFrame, rects: DataFrame, keys: Sequence[str], share: float = 0.5) -> DataFrame:
    """Pixels outside the rectangles, without components that lie inside them by `share` or more.
    rects(keys, rx0, ry0, rx1, ry1) per key is a short list drawn by hand."""
    r = F.collect_list(F.struct("rx0", "ry0", "rx1", "ry1")).alias("_r")
    j = labelled.join(rects.groupBy(*keys).agg(r), list(keys), "left")
    hit = F.exists("_r", lambda q: (F.col("x") >= q["rx0"]) & (F.col("x") < q["rx1"]) & (F.col("y") >= q["ry0"]) & (F.col("y") < q["ry1"]))
    j = j.withColumn("_in", F.coalesce(hit, F.lit(False))).drop("_r")
    kill = j.groupBy(*keys, "component").agg(F.count_if("_in").alias("_i"), F.count(F.lit(1)).alias("_n")).where(F.col("_i") >= share * F.col("_n"))
    return j.where(~F.col("_in")).join(kill, [*keys, "component"], "left_anti").drop("_in")


def darkness_classes(labelled: DataFrame, keys: Sequence[str], paper: DataFrame, limit: float = 0.5, min_contrast: float = 0.05) -> DataFrame:
    """Relative lightness of each component between the ink of the largest component and the paper; too light ones are
    dropped. labelled holds grey, paper(keys, paper) one median per key; off when the contrast is too small.
    labelled is read more than once and should be stored."""
    med = exact_quantiles(labelled, [*keys, "component"], "grey", {"grey": 0.5}, "area", many=True)
    ref = med.groupBy(*keys).agg(F.max(F.struct("area", F.col("component").alias("c"), F.col("grey").alias("g"))).alias("_m"))
    j = med.join(ref.select(*keys, F.col("_m.g").alias("ink")), list(keys)).join(paper, list(keys))
    contrast = F.col("paper") - F.col("ink")
    rel = F.when(contrast >= min_contrast, (F.col("grey") - F.col("ink")) / contrast)
    return j.withColumn("rel", rel).withColumn("dropped", F.coalesce(F.col("rel") > limit, F.lit(False)))
