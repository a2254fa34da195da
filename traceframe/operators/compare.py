"""Sequence and mask comparison: alignment, rasters, overlap, boundary distance, counters, score rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions.ordered import neighbours
from traceframe.functions.quantiles import exact_quantiles
from traceframe.operators import cases as K
from traceframe.operators import geometry as G
from traceframe.operators import matching as M
from traceframe.operators.groups import by_rows, numbered, solved_groups, solved_in_place
from traceframe.operators.resample import resample_by_step
from traceframe.operators.tiles import TILE, tiled_pairs
from traceframe.session import checkpointed

# ------------------------------------------------------------------- alignment


def _diagonal(a: np.ndarray, b: np.ndarray, s: int, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Costs of the cells (i, s - i), the first i and the move into each cell.

    Costs are arrays over i with one infinite cell in front. Moves: 0 from (i-1, j-1), 1 from (i-1, j), 2 from (i, j-1); the
    first of equal ones counts.
    """
    lo, hi = max(0, s - len(b) + 1), min(s, len(a) - 1)
    i = np.arange(lo, hi + 1)
    gap = np.hypot(a[i, 0] - b[s - i, 0], a[i, 1] - b[s - i, 1])
    new = np.full(len(a) + 1, np.inf)
    if s == 0:
        new[1] = gap[0]
        return new, 0, np.zeros(1, dtype=np.int8)
    ways = np.stack([before[i], last[i], last[i + 1]])
    move = ways.argmin(axis=0).astype(np.int8)
    new[i + 1] = ways[move, np.arange(len(i))] + gap
    return new, lo, move


def alignment_path(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Cheapest warping path of two point sequences (indices of both sides) and its cost.

    A cell costs its distance and the least of its three predecessors, so all cells with the same i + j follow from the two
    diagonals before at once. Two neighbouring diagonals are kept at every k-th place; the moves between are made again
    while walking back, so memory grows with n * sqrt(n + m).
    """
    n, m = len(a), len(b)
    total = n + m - 1
    every = max(1, math.isqrt(total))
    kept = {}
    before = last = np.full(n + 1, np.inf)
    for s in range(total):
        if s % every == 0:
            kept[s] = (before, last)
        new, _, _ = _diagonal(a, b, s, before, last)
        before, last = last, new
    cost = float(last[n])
    i, s = n - 1, total - 1
    path = [(i, m - 1)]
    while s > 0:
        start = s // every * every
        before, last = kept[start]
        moves = []
        for t in range(start, s + 1):
            new, lo, move = _diagonal(a, b, t, before, last)
            moves.append((lo, move))
            before, last = last, new
        while s >= start and s > 0:
            lo, move = moves[s - start]
            way = move[i - lo]
            i -= way != 2
            s -= 2 if way == 0 else 1
            path.append((i, s - i))
    ends = np.array(path[::-1])
    return ends[:, 0], ends[:, 1], cost


#: Cells of the cost matrices, with their padding, that are filled together, and those of a case that is filled alone; a byte each.
CELLS_AT_ONCE, CELLS_OF_CASE = 1 << 24, 1 << 26


def _aligned(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`alignment_path` of many cases at once: (case, i, j) of all paths and the costs; points of shorter cases are padded.

    A cell only follows from those with no larger i and j, so what stands in the padding reaches no path.
    """
    cases, rows, columns = len(a), a.shape[1], b.shape[1]
    end = n + m - 2
    moves = np.zeros((int(end.max()) + 1, cases, rows), dtype=np.int8)
    # the other side from its end, so that a diagonal is a run of both
    ax, ay, bx, by = (np.ascontiguousarray(v) for v in (a[:, :, 0], a[:, :, 1], b[:, ::-1, 0], b[:, ::-1, 1]))
    odd = bool(np.isnan(a).any() or np.isnan(b).any())
    before, last, new = (np.full((cases, rows + 2), np.inf) for _ in range(3))
    cost = np.empty(cases)
    for s in range(len(moves)):
        lo, hi = max(0, s - columns + 1), min(s, rows - 1) + 1
        at = columns - 1 - s
        value = np.hypot(ax[:, lo:hi] - bx[:, lo + at : hi + at], ay[:, lo:hi] - by[:, lo + at : hi + at])
        if s:
            # the first of equal ways counts, and an unknown one is the least
            best, up, left = before[:, lo:hi], last[:, lo:hi], last[:, lo + 1 : hi + 1]
            move = moves[s, :, lo:hi]
            if odd:
                np.copyto(move, np.stack([best, up, left]).argmin(axis=0), casting="unsafe")
            else:
                move[:] = up < best
            best = np.minimum(best, up)
            if not odd:
                np.copyto(move, 2, where=left < best)
            value += np.minimum(best, left)
        new[:, lo + 1 : hi + 1] = value
        new[:, lo] = new[:, hi + 1] = np.inf
        done = np.flatnonzero(end == s)
        cost[done] = new[done, n[done]]
        before, last, new = last, new, before
    case, i, s = np.arange(cases), n - 1, end
    path = [(case, i, s - i)]
    while True:
        live = s > 0
        if not live.any():
            break
        case, i, s = case[live], i[live], s[live]
        way = moves[s, case, i]
        i, s = i - (way != 2), s - np.where(way == 0, 2, 1)
        path.append((case, i, s - i))
    case, i, j = (np.concatenate(x) for x in zip(*path[::-1]))
    by = np.argsort(case, kind="stable")
    return case[by], i[by], j[by], cost


def alignment_paths(xy: np.ndarray, first: np.ndarray, n: np.ndarray, m: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(case, i, j) of the cheapest paths and their costs, for cases whose `n` points of one side and then `m` of the other
    begin at row `first` of `xy`. `back` reads the other side from its end.

    Cases of about the same length are filled together; one that is too long for that is left to `alignment_path`.
    """
    def side(at: np.ndarray, size: np.ndarray, turned: bool) -> np.ndarray:
        k = np.minimum(np.arange(size.max()), size[:, None] - 1)
        return xy[at[:, None] + (size[:, None] - 1 - k if turned else k)]

    by = np.lexsort((n, n + m))
    out, cost, lo = [], np.empty(len(n)), 0
    while lo < len(by):
        # cases come by their length, so the last one of a part has the most diagonals
        most = np.maximum.accumulate(n[by[lo:]])
        widest = np.maximum.accumulate(m[by[lo:]])
        cells = most * (most + widest) * np.arange(1, len(most) + 1)
        hi = lo + max(1, int(np.searchsorted(cells, CELLS_AT_ONCE, side="right")))
        some = by[lo:hi]
        if cells[0] > max(CELLS_AT_ONCE, CELLS_OF_CASE):
            a, b = (side(at, size, turned)[0] for at, size, turned in ((first[some], n[some], False), (first[some] + n[some], m[some], back)))
            i, j, cost[some[0]] = alignment_path(a, b)
            out.append((np.full(len(i), some[0]), i, j))
        else:
            case, i, j, cost[some] = _aligned(side(first[some], n[some], False), side(first[some] + n[some], m[some], back), n[some], m[some])
            out.append((some[case], i, j))
        lo = hi
    case, i, j = (np.concatenate(x) for x in zip(*out))
    by = np.argsort(case, kind="stable")
    return case[by], i[by], j[by], cost


def _both_sides(ref: DataFrame, cand: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points of both sides under `_side`; fresh column identities, since they often come from one table."""
    left, right = (df.select(*[F.col(c).alias(c) for c in (*keys, "i", "x", "y")]) for df in (ref, cand))
    return left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))


def _points_of(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, first row, points of one side, points of the other) of the cases that have both."""
    xy = np.stack([table[c].to_numpy().astype(float) for c in ("x", "y")], axis=1)
    m = np.add.reduceat(table["_side"].to_numpy(), first)
    n = np.diff(np.append(first, table.num_rows)) - m
    both = (n > 0) & (m > 0)
    return xy, first[both], n[both], m[both]


#: Points of a side up to which an alignment is one task; longer ones are dealt as tiles of the cost matrix.
POINTS_IN_TASK = 8192


def _by_length(ref: DataFrame, cand: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame | None, tuple[DataFrame, DataFrame, DataFrame, DataFrame]]:
    """Keys with a long side, if any, and both sides of the short and of the long keys."""
    long = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys) for df in (ref, cand)]
    long = checkpointed(long[0].union(long[1]).distinct())
    if long.isEmpty():
        return None, (ref, cand, ref, cand)
    return long, tuple(df.join(long, list(keys), how) for how in ("left_anti", "left_semi") for df in (ref, cand))


def dtw(ref: DataFrame, cand: DataFrame, keys: Sequence[str], limit: int = POINTS_IN_TASK, tile: int = TILE) -> DataFrame:
    """Alignment summary per key: mean cost, path length, most absorbed points, whether the reverse reads better.

    Both sides hold keys, i, x, y. Keys of up to `limit` points a side are decided many in a task, longer ones are dealt as tiles.
    """
    long, (short_ref, short_cand, long_ref, long_cand) = _by_length(ref, cand, keys, limit)
    short = _short_dtw(short_ref, short_cand, keys)
    if long is None:
        return short
    way = checkpointed(tiled_pairs(long_ref, long_cand, keys, tile))
    back = tiled_pairs(long_ref, long_cand.withColumn("i", -F.col("i")), keys, tile)
    absorbed = [way.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_k")).groupBy(*keys).agg(F.max("_k").alias(f"_{c}")) for c in ("i", "j")]
    there = way.groupBy(*keys).agg((F.sum("dist") / F.count(F.lit(1))).alias("dtw"), F.count(F.lit(1)).alias("path_len"))
    j = there.join(absorbed[0], list(keys)).join(absorbed[1], list(keys))
    j = j.join(back.groupBy(*keys).agg((F.sum("dist") / F.count(F.lit(1))).alias("_back")), list(keys))
    return short.unionByName(
        j.select(*keys, "dtw", "path_len", F.greatest("_i", "_j").alias("max_absorption"), (F.col("_back") < F.col("dtw")).alias("reversed_better"))
    )


def _short_dtw(ref: DataFrame, cand: DataFrame, keys: Sequence[str]) -> DataFrame:
    def align(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        xy, at, n, m = _points_of(table, first)
        if not len(at):
            return at, {name: pa.array([], kind) for name, kind in kinds.items()}
        case, i, j, cost = alignment_paths(xy, at, n, m)
        back_case, _, _, back = alignment_paths(xy, at, n, m, back=True)
        steps, back_steps = np.bincount(case), np.bincount(back_case)
        most = np.zeros(len(at), dtype=np.int64)
        for place in (i, j):
            # a path never turns back, so the steps at one point are a run
            run = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (case[1:] != case[:-1])))
            np.maximum.at(most, case[run], np.diff(np.append(run, len(case))))
        mean = cost / steps
        return at, {name: pa.array(v, kind) for (name, kind), v in zip(kinds.items(), (mean, steps, most, back / back_steps < mean))}

    kinds = {"dtw": pa.float64(), "path_len": pa.int64(), "max_absorption": pa.int64(), "reversed_better": pa.bool_()}
    extra = "dtw DOUBLE, path_len BIGINT, max_absorption BIGINT, reversed_better BOOLEAN"
    return solved_groups(_both_sides(ref, cand, keys), keys, ["_side", F.col("i").asc_nulls_last()], align, extra)


def alignment_pairs(ref: DataFrame, cand: DataFrame, keys: Sequence[str], limit: int = POINTS_IN_TASK, tile: int = TILE) -> DataFrame:
    """Matched pairs of the alignment: (keys, i, j, dist), the points of each side numbered from 0."""
    long, (short_ref, short_cand, long_ref, long_cand) = _by_length(ref, cand, keys, limit)
    short = _short_pairs(short_ref, short_cand, keys)
    return short if long is None else short.unionByName(tiled_pairs(long_ref, long_cand, keys, tile).select(short.columns))


def _short_pairs(ref: DataFrame, cand: DataFrame, keys: Sequence[str]) -> DataFrame:
    def pairs(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        xy, at, n, m = _points_of(table, first)
        if not len(at):
            return at, {"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())}
        case, i, j, _ = alignment_paths(xy, at, n, m)
        gap = xy[at[case] + i] - xy[at[case] + n[case] + j]
        return at[case], {"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "dist": pa.array(np.hypot(*gap.T), pa.float64())}

    order = ["_side", F.col("i").asc_nulls_last()]
    return solved_groups(_both_sides(ref, cand, keys), keys, order, pairs, "i BIGINT, j BIGINT, dist DOUBLE")


def residual_profile(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean matched distance per reference sample."""
    return pairs.groupBy(*keys, "i").agg(F.avg("dist").alias("residual"))


def body_sequence(trace: DataFrame, step: float, body_only: bool = True) -> DataFrame:
    """Strokes resampled one by one and concatenated in order: (case_id, stroke, x, y, i); marks left out on request."""
    if body_only:
        marks = G.stroke_classes(trace).where("is_mark").select("case_id", "stroke")
        trace = trace.join(marks, ["case_id", "stroke"], "left_anti")
    return sampled(trace, step).select("case_id", "stroke", "x", "y", F.col("idx").alias("i"))


def chamfer(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Mean nearest distance in both directions, kept apart."""
    a, b = checkpointed(a), checkpointed(b)
    ab = M.nearest_distances(a, b, keys, cell).groupBy(*keys).agg(F.avg("dist").alias("a_to_b"))
    ba = M.nearest_distances(b, a, keys, cell).groupBy(*keys).agg(F.avg("dist").alias("b_to_a"))
    return ab.join(ba, list(keys))


# --------------------------------------------------------------------- rasters


def rasterised(segs: DataFrame, keys: Sequence[str], width: Column, height: Column, singles: DataFrame | None = None) -> DataFrame:
    """Distinct pixels of segments (x0, y0, x1, y1), sampled at most half a pixel apart and rounded half to even;
    samples outside the grid are dropped. `singles` (x, y) adds strokes of one point."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 0.5)).cast("int")
    s = segs.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    t = F.col("_k") / F.col("_n")
    pts = s.select(*keys, (F.col("x0") * (1 - t) + F.col("x1") * t).alias("x"), (F.col("y0") * (1 - t) + F.col("y1") * t).alias("y"))
    if singles is not None:
        pts = pts.unionByName(singles.select(*keys, "x", "y"))
    px = pts.select(*keys, F.bround("x").cast("int").alias("x"), F.bround("y").cast("int").alias("y"))
    return px.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).distinct()


def mask_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Areas, IoU and Dice of two pixel tables per key."""
    j = a.select(*keys, "x", "y", F.lit(True).alias("_a")).join(b.select(*keys, "x", "y", F.lit(True).alias("_b")), [*keys, "x", "y"], "full_outer")
    g = j.groupBy(*keys).agg(
        F.count("_a").alias("area_a"), F.count("_b").alias("area_b"), F.count_if(F.col("_a") & F.col("_b")).alias("inter"), F.count(F.lit(1)).alias("union")
    )
    return g.withColumn("iou", F.col("inter") / F.col("union")).withColumn("dice", 2 * F.col("inter") / (F.col("area_a") + F.col("area_b")))


#: Fixed value: a candidate is dilated this often at most, so on a wider grid the search ends there.
MAX_DILATIONS = 64


#: Rows of a mask, and pixels of its grid, up to which a mask is decided in one task.
ROWS_OF_MASK, PIXELS_OF_GRID = 1 << 14, 1 << 18


def _typed(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def _first_drop(cand: np.ndarray, ink: np.ndarray, width: int, height: int) -> tuple[float, int, float]:
    """(largest IoU, k, undilated IoU) of two sets of pixels (rows x, y)."""
    within = lambda p, m: p[(p[:, 0] >= -m) & (p[:, 0] < width + m) & (p[:, 1] >= -m) & (p[:, 1] < height + m)]
    seen, held = np.zeros((2, width, height), dtype=bool)
    seen[tuple(within(cand, 0).T)] = True
    held[tuple(within(ink, 0).T)] = True
    # pixels beyond the grid count in the first round; only those at its border reach into it
    ring = np.zeros((width + 2, height + 2), dtype=bool)
    ring[tuple((within(cand, 1) + 1).T)] = True
    both = np.concatenate([cand, ink])
    area, inter, best, at, first = len(cand), len(both) - len(np.unique(both, axis=0)), -1.0, 0, 0.0
    for k in range(MAX_DILATIONS + 1):
        iou = inter / (area + len(ink) - inter) if area + len(ink) - inter > 0 else 0.0
        first = iou if k == 0 else first
        dropped = iou < best
        if iou > best:
            best, at = iou, k
        if dropped or area == 0 or k == MAX_DILATIONS:
            break
        rows = ring[:-2] | ring[1:-1] | ring[2:]
        new = (rows[:, :-2] | rows[:, 1:-1] | rows[:, 2:]) & ~seen
        if not new.any():
            break
        seen |= new
        ring[:] = False
        ring[1:-1, 1:-1] = new
        area, inter = area + int(new.sum()), inter + int((new & held).sum())
    return best, at, first


def adaptive_iou(cand: DataFrame, ink: DataFrame, keys: Sequence[str], width: int, height: int, in_task: int = ROWS_OF_MASK) -> DataFrame:
    """Largest IoU over square dilations of the candidate up to its first drop: value, k, and the undilated IoU.

    A mask of up to `in_task` pixels of both sides on a grid of bounded size is one task, others are dilated in rounds over all tasks.
    """
    sides = [df.select(*keys, "x", "y").distinct() for df in (cand, ink)]
    if width * height > PIXELS_OF_GRID:
        return _spread_iou(*sides, keys, width, height)
    small, large = by_rows([checkpointed(df) for df in sides], keys, in_task)

    def decide(table: pa.Table) -> pa.Table:
        side = table["_ink"].to_numpy()
        p = np.stack([table[c].to_numpy().astype(np.int64) for c in ("x", "y")], axis=1)
        found = _first_drop(p[~side], p[side], width, height)
        out = table.slice(0, 1).select(list(keys)).combine_chunks()
        for name, value, kind in zip(("aiou", "k", "iou_k0"), found, (pa.float64(), pa.int32(), pa.float64())):
            out = out.append_column(name, pa.array([value], kind))
        return out

    rows = small[0].withColumn("_ink", F.lit(False)).unionByName(small[1].withColumn("_ink", F.lit(True)))
    out = rows.groupBy(*keys).applyInArrow(decide, f"{_typed(cand, keys)}, aiou double, k int, iou_k0 double")
    return out if large is None else out.unionByName(_spread_iou(*large, keys, width, height))


def _spread_iou(cand: DataFrame, ink: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """The same in rounds: the dilated area grows by one ring per round; a mask leaves the loop at its first drop."""
    ink = checkpointed(ink.select(*keys, "x", "y").distinct())
    n_ink = checkpointed(ink.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ink")))
    ring = checkpointed(cand.select(*keys, "x", "y").distinct())
    seen = ring
    masks = n_ink.select(*keys).unionByName(ring.select(*keys)).distinct()
    zero = F.lit(0).cast("bigint")
    state = checkpointed(
        masks.select(*keys, zero.alias("area"), zero.alias("inter"), F.lit(-1.0).alias("best"), F.lit(0).alias("k"), F.lit(0.0).alias("iou_k0"))
    )
    settled = state.limit(0)
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    for k in range(MAX_DILATIONS + 1):
        hit = ink.select(*keys, "x", "y", F.lit(1).alias("_h"))
        gain = ring.join(hit, [*keys, "x", "y"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("_da"), F.count("_h").alias("_di"))
        s = state.join(gain, list(keys), "left").join(n_ink, list(keys), "left")
        area = F.col("area") + F.coalesce("_da", zero)
        inter = F.col("inter") + F.coalesce("_di", zero)
        # a mask whose ring is empty fills its grid and cannot change any more
        full = F.lit(k > 0) & F.col("_da").isNull()
        s = s.select(*keys, area.alias("area"), inter.alias("inter"), "best", "k", "iou_k0", F.coalesce("n_ink", zero).alias("_n"), full.alias("_full"))
        iou = F.when(F.col("area") + F.col("_n") - F.col("inter") > 0, F.col("inter") / (F.col("area") + F.col("_n") - F.col("inter"))).otherwise(0.0)
        s = s.withColumn("_iou", iou)
        better = F.col("_iou") > F.col("best")
        s = checkpointed(
            s.select(
                *keys,
                "area",
                "inter",
                F.when(better, F.col("_iou")).otherwise(F.col("best")).alias("best"),
                F.when(better, F.lit(k)).otherwise(F.col("k")).alias("k"),
                F.when(F.lit(k == 0), F.col("_iou")).otherwise(F.col("iou_k0")).alias("iou_k0"),
                ((F.col("_iou") < F.col("best")) | (F.col("area") == 0) | F.col("_full")).alias("_stop"),
            )
        )
        settled = settled.unionByName(s.where("_stop").drop("_stop"))
        state = s.where("NOT _stop").drop("_stop")
        if state.isEmpty() or k == MAX_DILATIONS:
            break
        # the next ring: pixels around the last one that are not in yet, only of masks still growing
        live = ring.join(state.select(*keys), list(keys), "left_semi").withColumn("_m", F.explode(moves))
        grown = live.select(*keys, (F.col("x") + F.col("_m.i")).alias("x"), (F.col("y") + F.col("_m.j")).alias("y")).where(inside).distinct()
        ring = checkpointed(grown.join(seen, [*keys, "x", "y"], "left_anti"))
        seen = checkpointed(seen.join(state.select(*keys), list(keys), "left_semi").unionByName(ring))
    return settled.unionByName(state).select(*keys, F.col("best").alias("aiou"), "k", "iou_k0")


def boundary(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels with at least one of their four neighbours outside the mask."""
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    m = mask.withColumn("_m", F.explode(moves))
    m = m.select(*keys, "x", "y", (F.col("x") + F.col("_m.i")).alias("nx"), (F.col("y") + F.col("_m.j")).alias("ny"))
    inside = mask.select(*keys, F.col("x").alias("nx"), F.col("y").alias("ny"))
    return m.join(inside, [*keys, "nx", "ny"], "left_anti").select(*keys, "x", "y").distinct()


def boundary_chamfer(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int, height: int, dead_band: float = 0.0) -> DataFrame:
    """Symmetric mean and the worse 95th percentile of boundary distances; an empty side costs the diagonal."""
    ba, bb = checkpointed(boundary(a, keys)), checkpointed(boundary(b, keys))
    masks = ba.select(*keys).unionByName(bb.select(*keys)).distinct()

    def side(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        d = M.nearest_distances(p, q, keys, 1.5).withColumn("dist", F.greatest(F.lit(0.0), F.col("dist") - dead_band))
        mean = d.groupBy(*keys).agg(F.avg("dist").alias(f"{name}_mean"))
        return mean.join(exact_quantiles(d, keys, "dist", {f"{name}_p95": 0.95}), list(keys))

    j = masks.join(side(ba, bb, "ab"), list(keys), "left").join(side(bb, ba, "ba"), list(keys), "left")
    diagonal = F.lit(math.hypot(width, height))
    return j.select(
        *keys,
        F.coalesce((F.col("ab_mean") + F.col("ba_mean")) / 2, diagonal).alias("chamfer_mean"),
        F.coalesce(F.greatest("ab_p95", "ba_p95"), diagonal).alias("chamfer_p95"),
    )


# ------------------------------------------------------------------- structure

# Limits of the structure detectors and of their matching, in x-heights.
PIERCE_WINDOW = 0.25
PIERCE_MARGIN = 0.05
RETRACE_PROX = 0.15
PARTNER_GAP = 1.0
MIN_PASS_ARC = 0.30
MIN_PAIRS = 3
PARTNER_NEAR = 0.16
PARTNER_HITS = 2
MIN_SEPARATION = 0.35
MERGE_RADIUS = 0.05
MATCH_RADIUS = 0.55


#: Points of a case up to which it is sampled in one task, and samples up to which its structure is found in one.
POINTS_OF_CASE, SAMPLES_OF_CASE = 1 << 13, 1 << 17
#: Points of cases that are sampled at once.
POINTS_AT_ONCE = 1 << 13


def sampled(trace: DataFrame, step: float, in_task: int = POINTS_OF_CASE) -> DataFrame:
    """Resampled traces with tangents, arc and index.

    Cases of up to `in_task` points are sampled many in a task and not stored: they are dealt as points, and what reads them finds
    each case whole and in order (`_dealt_cases`). Samples of larger cases are made over all tasks and stored.
    """
    known = trace.where("case_id IS NOT NULL AND stroke IS NOT NULL")
    (few,), many = by_rows([checkpointed(known.select("case_id", "stroke", "pos", "x", "y"))], ["case_id"], in_task)
    small = _sampled_cases(few, step)
    if many is None:
        out = small
    else:
        s = resample_by_step(many[0], ["case_id", "stroke"], step).withColumnRenamed("i", "pos")
        large = checkpointed(M.trace_samples(checkpointed(s)))
        out = small.unionByName(large)
        many = large
    out._by_case = (small, many)
    return out


def _sampled_cases(trace: DataFrame, step: float) -> DataFrame:
    points = trace.withColumns({c: F.col(c).cast("double") for c in ("x", "y")})

    def sample(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        # strokes by number, since any type of theirs will do
        stroke = table["stroke"].combine_chunks().dictionary_encode().indices.to_numpy()
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        at, s = K.samples_of(of, stroke, *K.columns(table, "x y"), step)
        known = lambda v: pa.array(v, mask=np.isnan(v))
        places = {c: known(getattr(s, c)) for c in ("x", "y", "arc", "tx", "ty")}
        return at, {"stroke": table["stroke"].take(pa.array(at)), "pos": pa.array(s.pos), **places, "idx": pa.array(s.idx)}

    extra = f"stroke {dict(points.dtypes)['stroke']}, pos bigint, x double, y double, arc double, tx double, ty double, idx bigint"
    return solved_groups(points, ["case_id"], ["stroke", "pos"], sample, extra, POINTS_AT_ONCE)


def _dealt_cases(samples: DataFrame) -> list[DataFrame]:
    """Samples by case with `_k`: as `sampled` left them, or dealt anew."""
    small, large = getattr(samples, "_by_case", (None, samples))
    parts = [] if small is None else [small.withColumn("_k", F.col("idx") + 1)]
    return parts + ([] if large is None else [numbered(large, ["case_id"], ["idx"])])


def structure_by_case(
    samples: DataFrame, step: float, tell: Callable[[K.Samples, K.Crossings, K.Zones, int], tuple[np.ndarray, dict[str, pa.Array]]], extra: str, in_task: int
) -> tuple[DataFrame, DataFrame | None]:
    """What `tell` says about the crossings and zones of cases of up to `in_task` samples, many in a task, and the samples of larger cases, if any.

    `tell` gets samples, crossings, zones and the number of cases; it returns the case of each row and the columns of `extra`.
    """
    reach, near = max(2, round(PIERCE_WINDOW / step)), max(1, math.ceil(PARTNER_NEAR / step))

    def solve(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        size = np.diff(np.append(first, table.num_rows))
        large = np.flatnonzero(size > in_task)
        of = np.repeat(np.arange(len(first)), size)
        rows = table.filter(pa.array(size[of] <= in_task)) if len(large) else table
        of = of[size[of] <= in_task]
        stroke = rows["stroke"].combine_chunks().dictionary_encode().indices.to_numpy()
        s = K.Samples(of, stroke, *K.columns(rows, "pos x y arc tx ty idx"))
        partner = K.partners_of(s, RETRACE_PROX)
        cross = K.piercing(s, partner, reach, PIERCE_MARGIN, near, PARTNER_HITS, MIN_SEPARATION, MERGE_RADIUS, M.MIN_CHORD)
        zones = K.zones_of(s, partner, step, MIN_PAIRS, PARTNER_GAP, MIN_PASS_ARC)
        case, told = tell(s, cross, zones, len(first))
        # a larger case is a row of its own, with nothing but its key
        keep = size[case] <= in_task
        at = np.concatenate([case[keep], large])
        flags = {"_large": pa.array(np.arange(len(at)) >= keep.sum())}
        wide = lambda v: pa.concat_arrays([v.filter(pa.array(keep)), pa.nulls(len(large), v.type)])
        return first[at], {name: wide(v) for name, v in told.items()} | flags

    parts = [solved_in_place(p.where(F.col("_k") <= in_task + 1), ["case_id"], solve, f"{extra}, _large boolean") for p in _dealt_cases(samples)]
    found = checkpointed(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    large = found.where("_large").select("case_id")
    rest = None if large.isEmpty() else checkpointed(samples.join(large, "case_id", "left_semi"))
    return found.where("NOT _large").drop("_large"), rest


def piercing_crossings(samples: DataFrame, step: float, partners: DataFrame | None = None) -> DataFrame:
    """Crossings whose two passes go through each other, without rings drawn inside one retrace, merged when close.
    Gives case_id, seg_i, seg_j, x, y, angle."""
    partners = M.retrace_partners(samples, RETRACE_PROX) if partners is None else partners
    raw = M.self_intersections(M.trace_segments(samples), cell=max(4 * step, 0.25)).where(F.col("separation") >= MIN_SEPARATION)
    raw = checkpointed(raw)
    reach = max(2, round(PIERCE_WINDOW / step))
    size = samples.groupBy("case_id", "stroke").agg((F.max("pos") + 1).alias("_len"))
    xid = ["case_id", "seg_i", "seg_j"]
    # both passes of a crossing as windows of samples
    sides = F.explode(
        F.array(
            F.struct(F.lit("a").alias("s"), F.col("stroke_i").alias("stroke"), F.col("pos_i").alias("at")),
            F.struct(F.lit("b").alias("s"), F.col("stroke_j").alias("stroke"), F.col("pos_j").alias("at")),
        )
    )
    w = checkpointed(raw.select(*xid, sides.alias("w")).select(*xid, "w.s", "w.stroke", "w.at").join(size, ["case_id", "stroke"]))
    w = w.withColumn("lo", F.greatest(F.lit(0), F.col("at") - reach)).withColumn("hi", F.least(F.col("_len") - 1, F.col("at") + 1 + reach))
    pts = w.select(*xid, "s", "stroke", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("pos")).join(
        samples.select("case_id", "stroke", "pos", "x", "y"), ["case_id", "stroke", "pos"]
    )
    line = G.total_least_squares(pts, [*xid, "s"])
    ends = pts.groupBy(*xid, "s").agg(F.min_by(F.struct("x", "y"), "pos").alias("p0"), F.max_by(F.struct("x", "y"), "pos").alias("p1"))
    flip = F.when(F.col("s") == "a", "b").otherwise("a")
    j = line.join(ends.withColumn("s", flip), [*xid, "s"])
    t = F.radians("axis_deg")

    def signed(p: str) -> Column:
        return F.cos(t) * (F.col(f"{p}.y") - F.col("cy")) - F.sin(t) * (F.col(f"{p}.x") - F.col("cx"))

    j = j.withColumn("d0", signed("p0")).withColumn("d1", signed("p1"))
    through = (F.col("d0") * F.col("d1") < 0) & (F.abs("d0") >= PIERCE_MARGIN) & (F.abs("d1") >= PIERCE_MARGIN)
    pierced = checkpointed(j.groupBy(*xid).agg(F.bool_and(through).alias("_ok")).where("_ok"))
    near = max(1, math.ceil(PARTNER_NEAR / step))

    def into(own: str, other: str, name: str) -> DataFrame:
        k = raw.select(*xid, F.explode(F.sequence(F.greatest(F.lit(0), F.col(own) - near), F.col(own) + near)).alias("idx"), F.col(other).alias("_o"))
        h = k.join(partners.select("case_id", "idx", "partner"), ["case_id", "idx"])
        return h.where(F.abs(F.col("partner") - F.col("_o")) <= near).groupBy(*xid).agg(F.count(F.lit(1)).alias(name))

    inside = into("seg_i", "seg_j", "_p").join(into("seg_j", "seg_i", "_q"), xid).where((F.col("_p") >= PARTNER_HITS) & (F.col("_q") >= PARTNER_HITS))
    found = raw.join(pierced, xid, "left_semi").join(inside, xid, "left_anti").withColumn("cross_id", F.struct("seg_i", "seg_j"))
    kept = M.suppressed(checkpointed(found), ["case_id"], "cross_id", [-F.col("angle"), F.col("seg_i"), F.col("seg_j")], MERGE_RADIUS)
    return kept.select("case_id", "seg_i", "seg_j", "x", "y", "angle")


def structure_zones(samples: DataFrame, step: float, partners: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(zones, passes). A pass is a run of samples with an anti-parallel partner; its class is overlap (another stroke),
    touch (far along the path), graze (too short) or retrace. Passes that are each other's ink form one zone."""
    partners = checkpointed(M.retrace_partners(samples, RETRACE_PROX) if partners is None else partners)
    flagged = partners.withColumn("hot", F.lit(True))
    t = samples.select("case_id", "stroke", "pos", "idx", "arc", "x", "y").join(flagged.select("case_id", "idx", "partner", "partner_stroke", "hot"), ["case_id", "idx"], "left")
    t = checkpointed(t.withColumn("hot", F.coalesce("hot", F.lit(False))))
    runs = G.islands(t.select("case_id", "stroke", "pos", "hot"), ["case_id", "stroke"], "pos", "hot", MIN_PAIRS).select("case_id", "stroke", "start", "end")
    member = checkpointed(runs.withColumn("pos", F.explode(F.sequence("start", "end"))).join(t.where("hot"), ["case_id", "stroke", "pos"]))
    keys = ["case_id", "stroke", "start", "end"]
    g = member.groupBy(*keys).agg(
        F.bool_or(F.col("partner_stroke") != F.col("stroke")).alias("foreign"),
        F.min("partner").alias("q0"),
        F.max("partner").alias("q1"),
        F.min("idx").alias("p0"),
        F.max("idx").alias("p1"),
        (F.max("arc") - F.min("arc")).alias("arc"),
        F.max(F.when(F.col("pos") == F.col("start") + F.floor((F.col("end") - F.col("start") + 1) / 2), F.struct("x", "y"))).alias("mid"),
    )
    gap = F.when(F.col("q0") > F.col("p1"), F.col("q0") - F.col("p1")).when(F.col("p0") > F.col("q1"), F.col("p0") - F.col("q1")).otherwise(0)
    cls = F.when(F.col("foreign"), "overlap").when(gap * step > PARTNER_GAP, "touch").when(F.col("arc") < MIN_PASS_ARC, "graze").otherwise("retrace")
    passes = checkpointed(g.withColumn("class", cls).withColumn("pass_id", F.struct("case_id", "p0")))
    of = member.join(passes.select(*keys, "class", "pass_id"), keys).select("case_id", "idx", "partner", "class", "pass_id")
    other = of.select("case_id", F.col("idx").alias("partner"), "class", F.col("pass_id").alias("b"))
    edges = of.join(other, ["case_id", "partner", "class"]).where(F.col("pass_id") != F.col("b")).select(F.col("pass_id").alias("a"), "b")
    real = passes.where("class <> 'graze'")
    zone = M.connected_components(real.select(F.col("pass_id").alias("id")), edges).withColumnRenamed("id", "pass_id")
    z = real.join(zone, "pass_id").groupBy("case_id", "class", "component").agg(
        F.avg("mid.x").alias("x"), F.avg("mid.y").alias("y"), F.sum("arc").alias("arc"), F.count(F.lit(1)).alias("passes")
    )
    return checkpointed(z), passes.drop("pass_id")


def trace_counters(samples: DataFrame, step: float, in_task: int = SAMPLES_OF_CASE) -> DataFrame:
    """Per case: crossings, zones per class and the arc spent retracing.

    Cases of up to `in_task` samples are counted many in a task, larger ones over all tasks.
    """
    counted = ("retrace", "touch", "overlap")

    def tell(s: K.Samples, cross: K.Crossings, zones: K.Zones, cases: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
        count = lambda rows, weights=None: np.bincount(s.of[rows], weights, minlength=cases)
        out = {"crossings": pa.array(count(cross.i))}
        out |= {c: pa.array(count(zones.row[zones.kind == K.CLASSES.index(c)])) for c in counted}
        again = zones.pass_class == K.CLASSES.index("retrace")
        return np.arange(cases), out | {"retrace_arc": pa.array(count(zones.pass_row[again], zones.pass_arc[again]))}

    extra = "crossings bigint, retrace bigint, touch bigint, overlap bigint, retrace_arc double"
    found, large = structure_by_case(samples, step, tell, extra, in_task)
    return found if large is None else found.unionByName(_spread_counters(large, step))


def _spread_counters(samples: DataFrame, step: float) -> DataFrame:
    """The same with every step over all tasks."""
    partners = checkpointed(M.retrace_partners(samples, RETRACE_PROX))
    cross = piercing_crossings(samples, step, partners).groupBy("case_id").agg(F.count(F.lit(1)).alias("crossings"))
    zones, passes = structure_zones(samples, step, partners)
    z = zones.groupBy("case_id").agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("retrace", "touch", "overlap")])
    arc = passes.where("class = 'retrace'").groupBy("case_id").agg(F.sum("arc").alias("retrace_arc"))
    j = samples.select("case_id").distinct().join(cross, "case_id", "left").join(z, "case_id", "left").join(arc, "case_id", "left")
    return j.select("case_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("crossings", "retrace", "touch", "overlap")], F.coalesce("retrace_arc", F.lit(0.0)).alias("retrace_arc"))


# --------------------------------------------------------------- registration

TX_UNITS, TY_PX = 0.6, 4
# Limits and weights of the registration, the word loss and the template score.
SATURATION = 0.6
WIDTH_LOG = math.log(1.5)


def registration(
    points: DataFrame, distances: DataFrame, keys: Sequence[str], xh: float, width: int, height: int, in_task: int = ROWS_OF_MASK
) -> DataFrame:
    """Best integer shift of sample points over a distance table (keys, px, py, d): the first with the smallest mean
    distance, tx within 0.6 xh of aligned left edges and ty within 4. Leaving the grid adds the clamp distance.

    Up to `in_task` points of a key meet the key's table on a grid of bounded size in one task; shifts of more are spread.
    """
    points = checkpointed(points.select(*keys, "x", "y"))
    if width * height > PIXELS_OF_GRID:
        m = _spread_shifts(points, distances, keys, xh, width, height)
    else:
        (few,), many = by_rows([points], keys, in_task)
        m = _shifts(few, distances, keys, xh, width, height)
        if many is not None:
            m = m.unionByName(_spread_shifts(many[0], distances, keys, xh, width, height))
    best = m.groupBy(*keys).agg(F.min(F.struct(F.round("d", 9).alias("d"), "tx", "ty")).alias("b"))
    return best.select(*keys, "b.tx", "b.ty", F.col("b.d").alias("mean_dist"))


def _shifts(points: DataFrame, distances: DataFrame, keys: Sequence[str], xh: float, width: int, height: int) -> DataFrame:
    """Mean distance of every shift (keys, tx, ty, d), a key in one task."""
    span = int(round(TX_UNITS * xh))

    def shift(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*keys, "tx", "ty", "d"]
        px, py, d = (right[c].to_numpy() for c in ("px", "py", "d"))
        x, y = (left[c].to_numpy().astype(float) for c in ("x", "y"))
        ink = px[d == 0]
        kinds = [*(left.schema.field(k).type for k in keys), pa.int32(), pa.int32(), pa.float64()]
        if not len(x) or not len(ink):
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        table = np.full((width, height), np.nan)
        table[px, py] = d
        start, rows = int(float(ink.min()) - x.min()), []
        for tx in range(start - span, start + span + 1):
            cx = np.clip(x + tx, 0.0, width - 1.0)
            for ty in range(-TY_PX, TY_PX + 1):
                cy = np.clip(y + ty, 0.0, height - 1.0)
                at = table[np.rint(cx).astype(int), np.rint(cy).astype(int)]
                there = ~np.isnan(at)
                if there.any():
                    rows.append((tx, ty, (at + np.hypot(x + tx - cx, y + ty - cy))[there].sum() / there.sum()))
        own = [pa.array([left[k][0].as_py()] * len(rows), t) for k, t in zip(keys, kinds)]
        cols = zip(*rows) if rows else ([], [], [])
        return pa.Table.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cols, kinds[len(keys) :]))], names=names)

    table = distances.select(*keys, "px", "py", "d").groupBy(*keys)
    return points.groupBy(*keys).cogroup(table).applyInArrow(shift, f"{_typed(points, keys)}, tx int, ty int, d double")


def _spread_shifts(points: DataFrame, distances: DataFrame, keys: Sequence[str], xh: float, width: int, height: int) -> DataFrame:
    """The same with every point and shift as a row."""
    span = int(round(TX_UNITS * xh))
    left = points.groupBy(*keys).agg(F.min("x").alias("_px"))
    ink = distances.where("d = 0").groupBy(*keys).agg(F.min("px").alias("_ix"))
    start = left.join(ink, list(keys)).select(*keys, (F.col("_ix") - F.col("_px")).cast("int").alias("_t0"))
    tx = F.explode(F.sequence(F.col("_t0") - span, F.col("_t0") + span)).alias("tx")
    s = points.join(start, list(keys)).select(*keys, "x", "y", tx).select("*", F.explode(F.sequence(F.lit(-TY_PX), F.lit(TY_PX))).alias("ty"))
    x, y = F.col("x") + F.col("tx"), F.col("y") + F.col("ty")
    cx, cy = F.least(F.greatest(x, F.lit(0.0)), F.lit(width - 1.0)), F.least(F.greatest(y, F.lit(0.0)), F.lit(height - 1.0))
    s = s.select(*keys, "tx", "ty", F.bround(cx).cast("int").alias("px"), F.bround(cy).cast("int").alias("py"), F.hypot(x - cx, y - cy).alias("_out"))
    # points that fall on one pixel of one shift look up the table once
    s = s.groupBy(*keys, "px", "py", "tx", "ty").agg(F.count(F.lit(1)).alias("_k"), F.sum("_out").alias("_out"))
    s = s.join(distances, [*keys, "px", "py"])
    return s.groupBy(*keys, "tx", "ty").agg((F.sum(F.col("d") * F.col("_k") + F.col("_out")) / F.sum("_k")).alias("d"))


def word_loss(forward: Column, reverse: Column, transition: Column, width_ratio: Column, xh: Column) -> Column:
    """0.45 transition + 0.35 coverage + 0.20 width, each saturated at 1; without connectors coverage stands in."""
    sat = SATURATION * xh
    coverage = F.least(F.lit(1.0), 0.5 * (forward + reverse) / sat)
    trans = F.coalesce(F.least(F.lit(1.0), transition / sat), coverage)
    width = F.least(F.lit(1.0), F.abs(F.log(width_ratio)) / WIDTH_LOG)
    return 0.45 * trans + 0.35 * coverage + 0.20 * width


def grid_distances(ink: DataFrame, keys: Sequence[str], width: int, height: int, in_task: int = ROWS_OF_MASK) -> DataFrame:
    """Distance of every grid pixel to the nearest ink pixel: (keys, px, py, d).

    A key of up to `in_task` ink pixels on a grid of bounded size is one task, others look for their pixels in cells.
    """
    if width * height > PIXELS_OF_GRID:
        return _spread_distances(ink, keys, width, height)
    (few,), many = by_rows([checkpointed(ink.select(*keys, "x", "y").distinct())], keys, in_task)
    gx, gy = (v.ravel() for v in np.indices((width, height)))

    def nearest(table: pa.Table) -> pa.Table:
        x, y = (table[c].to_numpy().astype(float) for c in ("x", "y"))
        d = np.full(len(gx), np.inf)
        block = max(1, (1 << 20) // len(gx))
        for at in range(0, len(x), block):
            d = np.minimum(d, ((gx[:, None] - x[at : at + block]) ** 2 + (gy[:, None] - y[at : at + block]) ** 2).min(axis=1))
        d = np.sqrt(d)
        own = [pa.array([table[k][0].as_py()] * len(d), table.schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*own, pa.array(gx, pa.int32()), pa.array(gy, pa.int32()), pa.array(d)], names=[*keys, "px", "py", "d"])

    out = few.groupBy(*keys).applyInArrow(nearest, f"{_typed(ink, keys)}, px int, py int, d double")
    return out if many is None else out.unionByName(_spread_distances(many[0], keys, width, height))


def _spread_distances(ink: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """The same by cells around every grid pixel."""
    cells = ink.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    cells = cells.select(*keys, "x", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    d = M.nearest_distances(cells, ink.select(*keys, "x", "y"), keys, 4.0)
    return d.select(*keys, F.col("x").alias("px"), F.col("y").alias("py"), F.col("dist").alias("d"))


# ------------------------------------------------------------------ composites


def weighted_score(gate: Column, parts: Sequence[tuple[float, Column]]) -> Column:
    """100 * gate^0.5 * weighted mean of the applicable parts; a null part drops its weight, none applicable leaves the gate."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for w, p in parts:
        top = top + F.when(p.isNotNull(), w * p).otherwise(0.0)
        bottom = bottom + F.when(p.isNotNull(), w).otherwise(0.0)
    mean = F.when(bottom > 0, top / bottom).otherwise(1.0)
    return 100.0 * F.sqrt(gate) * mean


def template_score(dice: Column, chamfer_px: Column, geo_px: Column, waviness: Column, unit: Column) -> Column:
    """0.45 dice + 0.25 boundary + 0.20 centre line + 0.10 width waviness, as exponential decays, times 100."""
    return 100.0 * (
        0.45 * dice
        + 0.25 * F.exp(-chamfer_px / (0.05 * unit))
        + 0.20 * F.exp(-geo_px / (0.08 * unit))
        + 0.10 * F.exp(-F.greatest(F.lit(0.0), waviness - 1.0))
    )


def targets(word_counts: DataFrame, letter_counts: DataFrame, slots: DataFrame) -> DataFrame:
    """Expected structure per word: counted on the composed strokes and summed over its letters.
    word_counts(case_id, crossings, retrace), letter_counts(key, crossings, retrace), slots(case_id, key)."""
    lettered = slots.join(letter_counts.withColumnsRenamed({"crossings": "_c", "retrace": "_z"}), "key", "left")
    s = lettered.groupBy("case_id").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("letters_crossings"), F.coalesce(F.sum("_z"), F.lit(0)).alias("letters_zones"))
    w = word_counts.select("case_id", F.col("crossings").alias("word_crossings"), F.col("retrace").alias("word_zones"))
    return w.join(s, "case_id", "full_outer")


def excursions(distances: DataFrame, keys: Sequence[str], step: float, thresholds: Sequence[float] = (0.35, 0.5)) -> DataFrame:
    """Largest distance and the arc spent beyond each threshold."""
    arcs = [(F.count_if(F.col("dist") > t) * step).alias(f"arc_{t}".replace(".", "_")) for t in thresholds]
    return distances.groupBy(*keys).agg(F.max("dist").alias("max"), *arcs)


def flow_breaks(items: DataFrame, word: Sequence[str], pos: str, eps: float) -> DataFrame:
    """Gaps between the end of an item and the start of the next one that is not a lift.
    items(word, pos, x0, y0, x1, y1, lift)."""
    n = neighbours(items, word, pos, {"_x": ("x1", -1), "_y": ("y1", -1)})
    d = F.hypot(F.col("x0") - F.col("_x"), F.col("y0") - F.col("_y"))
    return n.withColumn("dist", d).where((F.col("dist") > eps) & ~F.col("lift")).select(*word, pos, F.col("_x").alias("x"), F.col("_y").alias("y"), "dist")
