"""Sampling and structure of whole cases, many at once in one task: what `compare` does over all tasks for larger cases.

A case is the rows of one trace in order of stroke and position; `of` numbers the case of each row. Unknown coordinates are NaN.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Pairs of rows, or rows of windows, looked at together.
PAIRS_AT_ONCE = 1 << 20


def columns(table: pa.Table, names: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names.split()]


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): for each range its number and the places first, first + 1, ... of its `size`."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) + np.repeat(first - np.cumsum(size) + size, size)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums within each run, added one after the other."""
    out = np.empty(len(values))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(values)]):
        np.cumsum(values[lo:hi], out=out[lo:hi])
    return out


def _steps(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distance from the row before; none at the start of a run or beside an unknown place."""
    step = np.zeros(len(x))
    step[1:] = np.hypot(x[1:] - x[:-1], y[1:] - y[:-1])
    step[first] = 0.0
    return np.nan_to_num(step, nan=0.0, posinf=np.inf)


# -------------------------------------------------------------------- samples


@dataclass
class Samples:
    of: np.ndarray
    stroke: np.ndarray
    pos: np.ndarray
    x: np.ndarray
    y: np.ndarray
    arc: np.ndarray
    tx: np.ndarray
    ty: np.ndarray
    idx: np.ndarray  # number of the row in its case


def resampled(of: np.ndarray, stroke: np.ndarray, x: np.ndarray, y: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first point of the stroke, first sample of the stroke, position, x, y): strokes as max(2, round(arc / step) + 1) samples each, as
    `resample_by_step` has them."""
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (stroke[1:] != stroke[:-1]))) if len(of) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(of)) - 1 if len(of) else first
    arc = _sums(_steps(x, y, first), first)
    total = arc[last]
    n = np.where(total > 0, np.maximum(2, np.rint(total / step).astype(np.int64) + 1), 2)
    which, i = _spread(np.zeros(len(first), dtype=np.int64), n)
    begin = np.cumsum(n) - n
    t = total[which] * i / (n[which] - 1)
    # the segment with its start at or before t and its end behind it
    end = np.empty(len(t), dtype=np.int64)
    for lo, hi, a, z in zip(first.tolist(), last.tolist(), begin.tolist(), (begin + n).tolist()):
        end[a:z] = lo + np.searchsorted(arc[lo : hi + 1], t[a:z], side="right")
    at_end = i == n[which] - 1
    flat = total[which] <= 0
    end = np.where(flat, first[which], np.minimum(end, last[which]))
    start = np.where(flat, end, end - 1)
    length = arc[end] - arc[start]
    f = np.divide(t - arc[start], length, out=np.zeros(len(t)), where=length > 0)
    # an unknown first place is that of the point behind it
    head = lambda v: np.where(np.isnan(v[first]), v[np.minimum(first + 1, last)], v[first])
    x, y = (np.where(at_end, v[last[which]], np.where(flat, head(v)[which], v[start] + f * (v[end] - v[start]))) for v in (x, y))
    return first[which], begin, i, x, y


def _other(v: np.ndarray, beside: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The neighbour's value, or the own one where there is none."""
    near = np.where(there, v[beside], np.nan)
    return np.where(np.isnan(near), v, near)


def samples_of(of: np.ndarray, stroke: np.ndarray, x: np.ndarray, y: np.ndarray, step: float) -> tuple[np.ndarray, Samples]:
    """(a point of the stroke, samples): strokes resampled, with arc, unit tangents and their number in the case."""
    point, begin, pos, x, y = resampled(of, stroke, x, y, step)
    n = len(pos)
    of, stroke = of[point], stroke[point]
    arc = _sums(_steps(x, y, begin), begin)
    has_before, has_after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    has_before[begin] = False
    has_after[begin[1:] - 1] = False
    has_after[-1:] = False
    before, after = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, max(n - 1, 0))
    inner = has_before & has_after & ~np.isnan(x[before]) & ~np.isnan(x[after])
    half = np.where(inner, 2.0, 1.0)
    dx, dy = ((_other(v, after, has_after) - _other(v, before, has_before)) / half for v in (x, y))
    length = np.hypot(dx, dy)
    length[length == 0] = 1.0
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if n else np.zeros(0, dtype=np.int64)
    idx = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
    return point, Samples(of, stroke, pos, x, y, arc, dx / length, dy / length, idx)


# ------------------------------------------------------------------ structure


def close_pairs(of: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one case that may be within `radius` (and some others), each pair once, in parts.

    Rows are cut into lanes as high as the radius; a row meets those of its lane behind it and those of the lane above with a near x.
    """
    some = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    if len(some) < 2:
        return
    # a little wider than asked: the distance itself decides afterwards
    reach = max(radius, 1e-12) * (1 + 1e-9)
    lane = np.floor((y[some] - y[some].min()) / reach).astype(np.int64)
    code = of[some].astype(np.int64) * (int(lane.max()) + 2) + lane
    order = np.lexsort((x[some], code))
    some, code = some[order], code[order]
    codes, first = np.unique(code, return_index=True)
    ends = np.append(first[1:], len(code))
    own = np.searchsorted(codes, code)
    # lanes one after the other on a line, so that one search finds the rows with a near x
    far = x[some] - x[some].min()
    width = float(far.max()) + 2 * reach + 1
    line = own * width + far
    slack = reach + 1e-12 * width * len(codes)
    here = np.arange(len(some))
    up = np.minimum(own + 1, len(codes) - 1)
    above = codes[up] == code + 1
    tops = line + np.where(above, width, 0.0)
    ranges = [
        (here + 1, np.clip(np.searchsorted(line, line + slack, side="right"), here + 1, ends[own])),
        (
            np.where(above, np.clip(np.searchsorted(line, tops - slack, side="left"), first[up], ends[up]), 0),
            np.where(above, np.clip(np.searchsorted(line, tops + slack, side="right"), first[up], ends[up]), 0),
        ),
    ]
    for lo, hi in ranges:
        size = np.maximum(hi - lo, 0)
        total = np.cumsum(size)
        at = 0
        while at < len(some):
            done = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, side="right")))
            which, place = _spread(lo[at:to], size[at:to])
            yield some[at + which], some[place]
            at = to


#: Rounds in which points look for their nearest among near ones, with twice the reach in each.
ROUNDS = 4


def near_rows(
    of: np.ndarray, x: np.ndarray, y: np.ndarray, to: np.ndarray, u: np.ndarray, v: np.ndarray, radius: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of one side and a row of the other in the same case that may be within `radius` (and some others), in parts."""
    reach = radius * (1 + 1e-9)
    low = min(y.min(), v.min())
    lane, there = (np.floor((w - low) / reach).astype(np.int64) + 1 for w in (y, v))
    lanes = int(max(lane.max(), there.max())) + 2
    code = to.astype(np.int64) * lanes + there
    order = np.lexsort((u, code))
    codes, first = np.unique(code[order], return_index=True)
    ends = np.append(first[1:], len(order))
    begin = min(x.min(), u.min())
    width = float(max(x.max(), u.max()) - begin) + 2 * reach + 1
    line = np.repeat(np.arange(len(codes)), ends - first) * width + (u[order] - begin)
    slack = reach + 1e-12 * width * len(codes)
    for step in (-1, 0, 1):
        want = of * lanes + lane + step
        at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
        place = at * width + (x - begin)
        lo = np.clip(np.searchsorted(line, place - slack, side="left"), first[at], ends[at])
        hi = np.clip(np.searchsorted(line, place + slack, side="right"), lo, ends[at])
        size = np.where(codes[at] == want, hi - lo, 0)
        total = np.cumsum(size)
        k = 0
        while k < len(of):
            done = int(total[k - 1]) if k else 0
            end = max(k + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, side="right")))
            which, rows = _spread(lo[k:end], size[k:end])
            yield k + which, order[rows]
            k = end


def nearest_rows(of: np.ndarray, x: np.ndarray, y: np.ndarray, to: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, row of the other side) of the nearest row of the same case, the first of equal ones; row -1 where none is near.

    A row is settled when one lies within the reach of a round; what is left after the last round is for the caller.
    """
    least, nearest = np.full(len(of), np.inf), np.full(len(of), -1)
    some = np.flatnonzero(np.isfinite(u) & np.isfinite(v))
    todo = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    if not len(some) or not len(todo):
        return least, nearest
    to, u, v = to[some], u[some], v[some]
    wide, high = (float(max(p[todo].max(), q.max()) - min(p[todo].min(), q.min())) for p, q in ((x, u), (y, v)))
    each = len(some) / len(np.unique(to))
    radius = max(math.sqrt(wide) * math.sqrt(high) / math.sqrt(each), max(wide, high) / len(some))
    if not 0 < radius < math.inf or max(wide, high) / radius * (int(to.max()) + 1) > 1 << 40:
        return least, nearest
    for _ in range(ROUNDS):
        if not len(todo):
            break
        for a, b in near_rows(of[todo], x[todo], y[todo], to, u, v, radius):
            a = todo[a]
            dist = np.hypot(x[a] - u[b], y[a] - v[b])
            near = dist <= radius
            a, b, dist = a[near], some[b[near]], dist[near]
            order = np.lexsort((b, dist, a))
            a, b, dist = a[order], b[order], dist[order]
            lead = np.append(True, a[1:] != a[:-1])[: len(a)]
            a, b, dist = a[lead], b[lead], dist[lead]
            better = (dist < least[a]) | ((dist == least[a]) & (b < nearest[a]))
            least[a[better]], nearest[a[better]] = dist[better], b[better]
        todo = todo[nearest[todo] < 0]
        radius *= 2
    return least, nearest


def partners_of(s: Samples, prox: float, arc_factor: float = 3.0, max_angle: float = 25.0) -> np.ndarray:
    """Row of the nearest anti-parallel partner of each row, -1 without one; see `retrace_partners`."""
    found = []
    most = math.sin(math.radians(max_angle))
    for a, b in close_pairs(s.of, s.x, s.y, prox):
        far = (s.stroke[a] != s.stroke[b]) | (np.abs(s.arc[a] - s.arc[b]) > arc_factor * prox)
        a, b = a[far], b[far]
        dist = np.hypot(s.x[a] - s.x[b], s.y[a] - s.y[b])
        cross = np.abs(s.tx[a] * s.ty[b] - s.ty[a] * s.tx[b])
        good = (dist <= prox) & (cross <= most) & (s.tx[a] * s.tx[b] + s.ty[a] * s.ty[b] < 0)
        found.append((a[good], b[good], dist[good]))
    out = np.full(len(s.x), -1, dtype=np.int64)
    if found:
        a, b, dist = (np.concatenate(v) for v in zip(*found))
        own, other, dist = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([dist, dist])
        order = np.lexsort((other, dist, own))
        own, other = own[order], other[order]
        lead = np.append(True, own[1:] != own[:-1])[: len(own)]
        out[own[lead]] = other[lead]
    return out


@dataclass
class Crossings:
    i: np.ndarray  # rows at the start of both segments
    j: np.ndarray
    x: np.ndarray
    y: np.ndarray
    angle: np.ndarray

    def take(self, at: np.ndarray) -> Crossings:
        return Crossings(self.i[at], self.j[at], self.x[at], self.y[at], self.angle[at])


def crossings_of(s: Samples, min_chord: float, min_gap: int = 2) -> tuple[Crossings, np.ndarray]:
    """Proper intersections of the segments between samples and their separation along the stroke; see `self_intersections`."""
    n = len(s.x)
    goes_on = np.zeros(n, dtype=bool)
    goes_on[:-1] = (s.of[1:] == s.of[:-1]) & (s.stroke[1:] == s.stroke[:-1])
    # a segment and its length by the row it starts from; `at` are those that count
    x1, y1 = (np.where(goes_on, np.append(v[1:], np.nan)[:n], np.nan) for v in (s.x, s.y))
    rx, ry = x1 - s.x, y1 - s.y
    size = np.hypot(rx, ry)
    at = np.flatnonzero(size >= min_chord)
    found = []
    longest = float(size[at].max()) if len(at) else 0.0
    for p, q in close_pairs(s.of[at], s.x[at] + rx[at] / 2, s.y[at] + ry[at] / 2, longest):
        a, b = np.minimum(at[p], at[q]), np.maximum(at[p], at[q])
        apart = (s.stroke[a] != s.stroke[b]) | (s.pos[b] - s.pos[a] >= min_gap)
        a, b = a[apart], b[apart]
        qx, qy = s.x[b] - s.x[a], s.y[b] - s.y[a]
        den = rx[a] * ry[b] - ry[a] * rx[b]
        with np.errstate(divide="ignore", invalid="ignore"):
            ta, tb = (qx * ry[b] - qy * rx[b]) / den, (qx * ry[a] - qy * rx[a]) / den
        hit = (np.abs(den) >= min_chord) & (ta >= 0) & (ta < 1) & (tb >= 0) & (tb < 1)
        # a pair's boxes touch where it crosses; rounding at an end of a segment must not add one
        for v, w in ((s.x, x1), (s.y, y1)):
            hit &= (np.maximum(v[a], w[a]) >= np.minimum(v[b], w[b])) & (np.maximum(v[b], w[b]) >= np.minimum(v[a], w[a]))
        found.append((a[hit], b[hit], ta[hit], tb[hit]))
    a, b, ta, tb = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),) * 2
    cos = np.abs(rx[a] * rx[b] + ry[a] * ry[b]) / (size[a] * size[b])
    separation = np.where(s.stroke[a] == s.stroke[b], np.abs(s.arc[b] + tb * size[b] - s.arc[a] - ta * size[a]), np.inf)
    return Crossings(a, b, s.x[a] + ta * rx[a], s.y[a] + ta * ry[a], np.degrees(np.arccos(np.minimum(1.0, cos)))), separation


def _through(s: Samples, line: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(yes, no): whether the window `other` (first and last row) passes through the best line of the window `line`; neither if unknown."""
    which, at = _spread(line[0], line[1] - line[0] + 1)
    first = np.cumsum(line[1] - line[0] + 1) - (line[1] - line[0] + 1)
    x, y = s.x[at], s.y[at]

    def mean(v: np.ndarray) -> np.ndarray:
        known = ~np.isnan(v)
        with np.errstate(invalid="ignore"):
            return np.add.reduceat(np.where(known, v, 0.0), first) / np.add.reduceat(known.astype(float), first)

    cx, cy = mean(x), mean(y)
    ux, uy = x - cx[which], y - cy[which]
    t = 0.5 * np.arctan2(2 * mean(ux * uy), mean(ux * ux) - mean(uy * uy))
    d0, d1 = (np.cos(t) * (s.y[p] - cy) - np.sin(t) * (s.x[p] - cx) for p in other)
    known = ~np.isnan(d0) & ~np.isnan(d1)
    yes = (d0 * d1 < 0) & (np.abs(d0) >= margin) & (np.abs(d1) >= margin)
    return yes, (known & ~yes) | (np.abs(d0) < margin) | (np.abs(d1) < margin)


def _beside(s: Samples, partner: np.ndarray, own: np.ndarray, other: np.ndarray, near: int) -> np.ndarray:
    """How many rows within `near` of `own` have a partner within `near` of `other`."""
    out = np.zeros(len(own), dtype=np.int64)
    for k in range(-near, near + 1):
        at = np.clip(own + k, 0, len(s.of) - 1)
        there = (at == own + k) & (s.of[at] == s.of[own]) & (partner[at] >= 0)
        out += there & (np.abs(partner[at] - other) <= near)
    return out


def piercing(s: Samples, partner: np.ndarray, window: int, margin: float, near: int, hits: int, separation: float, merge: float, min_chord: float) -> Crossings:
    """Crossings whose passes go through each other, without rings inside a retrace, merged when close; see `piercing_crossings`."""
    raw, apart = crossings_of(s, min_chord)
    raw = raw.take(np.flatnonzero(apart >= separation))
    n = len(s.x)
    new = np.append(True, (s.of[1:] != s.of[:-1]) | (s.stroke[1:] != s.stroke[:-1]))[:n]
    begin = np.flatnonzero(new)
    of_stroke = np.cumsum(new) - 1
    end = np.append(begin[1:], n) - 1
    ok = np.zeros(len(raw.i), dtype=bool)
    at_once = max(1, PAIRS_AT_ONCE // (2 * window + 2))
    for lo in range(0, len(raw.i), at_once):
        i, j = raw.i[lo : lo + at_once], raw.j[lo : lo + at_once]
        a, b = ((np.maximum(begin[of_stroke[p]], p - window), np.minimum(end[of_stroke[p]], p + 1 + window)) for p in (i, j))
        (yes_a, no_a), (yes_b, no_b) = _through(s, a, b, margin), _through(s, b, a, margin)
        good = (yes_a | yes_b) & ~no_a & ~no_b
        good &= (_beside(s, partner, i, j, near) < hits) | (_beside(s, partner, j, i, near) < hits)
        ok[lo : lo + at_once] = good
    found = raw.take(np.flatnonzero(ok))
    # the best first; others within the radius of one that stays are the same crossing
    found = found.take(np.lexsort((found.j, found.i, -found.angle)))
    better, worse = [], []
    for a, b in close_pairs(s.of[found.i], found.x, found.y, merge):
        near_by = np.hypot(found.x[a] - found.x[b], found.y[a] - found.y[b]) <= merge
        better.append(np.minimum(a, b)[near_by])
        worse.append(np.maximum(a, b)[near_by])
    lost = np.zeros(len(found.i), dtype=bool)
    if better:
        a, b = np.concatenate(better), np.concatenate(worse)
        order = np.lexsort((a, b))
        for p, q in zip(a[order].tolist(), b[order].tolist()):
            if not lost[p]:
                lost[q] = True
    return found.take(np.flatnonzero(~lost))


CLASSES = ("overlap", "touch", "graze", "retrace")


@dataclass
class Zones:
    """Passes, and the zones that real ones form."""

    pass_row: np.ndarray  # first row of each pass
    pass_class: np.ndarray  # place in CLASSES
    pass_arc: np.ndarray
    row: np.ndarray  # first row of the first pass of each zone
    kind: np.ndarray
    x: np.ndarray
    y: np.ndarray


def zones_of(s: Samples, partner: np.ndarray, step: float, min_pairs: int, partner_gap: float, min_arc: float) -> Zones:
    """Runs of rows with a partner, told apart and joined to zones; see `structure_zones`."""
    hot = np.flatnonzero(partner >= 0)
    new = np.ones(len(hot), dtype=bool)
    new[1:] = (hot[1:] != hot[:-1] + 1) | (s.of[hot[1:]] != s.of[hot[:-1]]) | (s.stroke[hot[1:]] != s.stroke[hot[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(hot)))
    keep = size >= min_pairs
    hot = hot[np.repeat(keep, size)]
    size = size[keep]
    empty = np.zeros(0, dtype=np.int64)
    if not len(size):
        return Zones(empty, empty, np.zeros(0), empty, empty, np.zeros(0), np.zeros(0))
    first = np.cumsum(size) - size
    run = np.repeat(np.arange(len(size)), size)
    to = partner[hot]
    foreign = np.logical_or.reduceat(s.stroke[to] != s.stroke[hot], first)
    q0, q1 = np.minimum.reduceat(to, first), np.maximum.reduceat(to, first)
    p0, p1 = hot[first], hot[first + size - 1]
    arc = np.maximum.reduceat(s.arc[hot], first) - np.minimum.reduceat(s.arc[hot], first)
    gap = np.where(q0 > p1, q0 - p1, np.where(p0 > q1, p0 - q1, 0))
    kind = np.where(foreign, 0, np.where(gap * step > partner_gap, 1, np.where(arc < min_arc, 2, 3)))
    # passes that are each other's ink, by the run of the partner
    run_of = np.full(len(s.x), -1, dtype=np.int64)
    run_of[hot] = run
    a, b = run, run_of[to]
    tied = (b >= 0) & (a != b)
    a, b = a[tied], b[tied]
    alike = kind[a] == kind[b]
    a, b = a[alike], b[alike]
    root = np.arange(len(size))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    mid = hot[first + size // 2]
    real = np.flatnonzero(kind != 2)
    zone, member = np.unique(root[real], return_inverse=True)
    count = np.bincount(member, minlength=len(zone))
    x, y = (np.bincount(member, weights=v[mid[real]], minlength=len(zone)) / np.maximum(count, 1) for v in (s.x, s.y))
    return Zones(p0, kind, arc, p0[zone], kind[zone], x, y)
