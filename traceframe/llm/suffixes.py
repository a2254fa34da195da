"""Repeated byte strings of at least `length` bytes: suffix order and Burrows-Wheeler transform, bounded at that length.

A string of `length` bytes counts as repeated if it starts at two places or more, in one document or in several; every byte it
covers goes.

1. *Meeting points.* Of the `gram`-byte strings inside each window of `length` bytes the one with the smallest hash is the
   window's anchor. Equal windows have equal anchors, so they meet under the anchor's hash. Neighbouring windows mostly share
   one; the bytes under such a run are a *context*: some 570 bytes for every 170 of text, told by its place and a digest.
   Anchors that occur once drop out at once.
2. *Equal contexts* are counted by digest. One of each goes on and stands for the number of them.
3. *Index.* The different contexts of one anchor meet in a task, many anchors together. Their suffixes are sorted, and interval
   expansion on the Burrows-Wheeler transform derives the common prefixes of neighbours in increasing value: an interval of
   suffixes that begin with w is extended backwards to those of cw, and fixes one value when it ends at a place without. The expansion
   stops at `length`: places still without a value have common prefixes of at least that, which are the repeats.
4. *Very frequent anchors.* Where more than `limit` different contexts meet under one anchor, contexts are cut into parts
   of fewer windows (each an eighth or so of the windows before) that meet under the hash of the bytes common to all
   windows of the part. Inside a frequent passage the parts are equal and are counted; outside they are rare; at most a few
   windows at its ends go on, down to parts of one window, which the digest alone decides. No group grows with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import _powers, mix, squeezed_text, stored, text_bytes, unsqueezed_text
from traceframe.llm.units import apart, merged

SEGMENT = 1 << 19
#: suffixes whose intervals are extended together
EXPANDED = 1 << 19
_POSITION = 20


@dataclass(frozen=True)
class SuffixParameters:
    length: int = 400
    gram: int = 64
    limit: int = 5_000
    batch_bytes: int = 2 << 20
    #: windows of one part, level by level; the first is no cut at all
    parts: tuple[int, ...] = (1 << 20, 42, 6, 1)


# ---------------------------------------------------------------- suffix order and interval expansion


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of an array of symbols in the order of their first `length` symbols, at least; equal ones by place.

    Prefix doubling, from as many symbols as fit 62 bits; after the first round only suffixes that still have equals are
    sorted again.
    """
    n = len(text)
    bits = int(text.max()).bit_length() + 1
    h = 1 << (62 // bits).bit_length() - 1
    packed = np.zeros(n, dtype=np.int64)
    for k in range(h):
        packed <<= bits
        packed[: n - k] += text[k:]
        packed[: n - k] += 1
    order = np.argsort(packed, kind="stable").astype(np.int32)
    packed = packed[order]
    new = np.ones(n, dtype=bool)
    np.not_equal(packed[1:], packed[:-1], out=new[1:])
    del packed
    place = np.arange(n, dtype=np.int32)
    rank = np.zeros(n + 1, dtype=np.int32)
    first = np.maximum.accumulate(np.where(new, place, np.int32(0)))  # rank: place of the first equal
    rank[order] = first + 1
    while h < length:
        same = ~new
        same[:-1] |= ~new[1:]
        open_ = np.flatnonzero(same).astype(np.int32)
        del same
        if not len(open_):
            break
        at = order[open_]
        key = rank[at].astype(np.int64)
        key *= n + 1
        key += rank[np.minimum(at.astype(np.int64) + h, n)]
        by = np.argsort(key, kind="stable").astype(np.int32)
        order[open_] = at[by]
        key = key[by]
        del at, by
        new[open_[1:]] = key[1:] != key[:-1]
        new[open_[0]] = True
        del key
        np.maximum.accumulate(np.where(new, place, np.int32(0)), out=first)
        rank[order[open_]] = first[open_] + 1
        h *= 2
    return order


def short_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it where that is below `length`, else -1.

    Breadth-first interval expansion on the Burrows-Wheeler transform. Intervals are [lb, rb] of suffixes with a common
    prefix w; the characters before them split the interval, and because the order of suffixes with equal first symbol is the order of
    their rests, each part maps to one interval of cw. It is kept if the place after it has no value yet, which becomes |w|.
    """
    n = len(text)
    before = text[order - 1]  # the transform; the text is a ring, and its last symbol occurs once
    last_first = np.empty(n, dtype=np.int32)
    last_first[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    del before
    head = text[order]
    value = np.full(n + 1, -1, dtype=np.int32)
    value[0] = value[n] = 0
    # the interval of the empty word holds every suffix: its parts are the runs of equal first symbols
    lb = np.flatnonzero(np.append(True, head[1:] != head[:-1])).astype(np.int32)
    rb = np.append(lb[1:] - 1, n - 1).astype(np.int32)
    fresh = value[rb + 1] < 0
    lb, rb = lb[fresh], rb[fresh]
    value[rb + 1] = 0
    for depth in range(1, length):
        # intervals of one depth are disjoint, so they may be extended a slice at a time
        ends = np.cumsum(rb - lb + 1, dtype=np.int64)
        lo, left, right = 0, [], []
        while lo < len(lb):
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + EXPANDED, side="right")))
            a, b = _extended(lb[lo:hi], rb[lo:hi], last_first, head)
            fresh = value[b + 1] < 0
            a, b = a[fresh], b[fresh]
            value[b + 1] = depth
            left.append(a)
            right.append(b)
            lo = hi
        if not left:
            break
        lb, rb = np.concatenate(left), np.concatenate(right)
    return value[:n]


def _extended(lb: np.ndarray, rb: np.ndarray, last_first: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of cw for all c before w, for intervals [lb, rb] of words w."""
    width = rb - lb + 1
    ends = np.cumsum(width, dtype=np.int64)
    which = np.repeat(np.arange(len(lb), dtype=np.int32), width)
    to = last_first[np.arange(ends[-1]) + np.repeat(lb - (ends - width), width)]
    by = np.argsort(which.astype(np.int64) * len(head) + to, kind="stable")
    which, to = which[by], to[by]
    cut = np.ones(len(to), dtype=bool)
    cut[1:] = (which[1:] != which[:-1]) | (head[to[1:]] != head[to[:-1]])
    start = np.flatnonzero(cut)
    return to[start], to[np.append(start[1:], len(to)) - 1]


def repeated_places(contexts: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context the starts of its `length`-byte strings that occur twice or more, counted with the weights."""
    sizes = np.array([len(c) for c in contexts])
    total = int(sizes.sum()) + len(contexts)
    text = np.empty(total, dtype=np.int32)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    body = np.ones(total, dtype=bool)
    body[start[1:] - 1] = False
    text[body] = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    text[body] += np.int32(len(contexts))
    text[~body] = np.arange(len(contexts))  # ends differ from each other, so nothing common goes past one
    del body
    order = suffix_order(text, length)
    common = short_prefixes(text, order, length)
    del text
    group = np.cumsum(common >= 0, dtype=np.int32) - np.int32(1)
    del common
    owner = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes + 1)
    room = np.repeat((start[1:] - 1).astype(np.int32), sizes + 1) - np.arange(total, dtype=np.int32)
    whole = (room >= length)[order]
    del room
    # only whole strings count, so only they are weighed
    group, order = group[whole], order[whole]
    times = np.bincount(group, weights=weights[owner[order]])
    place = order[times[group] >= 2]
    place.sort()
    cuts = np.searchsorted(place, start)
    return [place[a:b].astype(np.int64) - s for a, b, s in zip(cuts[:-1], cuts[1:], start[:-1])]


# ---------------------------------------------------------------- contexts


class _Hasher:
    """Hashes of byte strings of any place and length in one segment, from running sums."""

    factors = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
    up: list[np.ndarray] = []
    down: list[np.ndarray] = []

    def __init__(self, raw: np.ndarray):
        if not self.up:
            _Hasher.up = [_powers(f, SEGMENT + 1) for f in self.factors]
            _Hasher.down = [_powers(pow(f, -1, 1 << 64), SEGMENT + 1) for f in self.factors]
        value = mix(np.arange(1, 257, dtype=np.uint64))[raw]
        self.total = [np.zeros(len(raw) + 1, dtype=np.uint64) for _ in self.factors]
        for t, up in zip(self.total, self.up):
            np.cumsum(value * up[: len(raw)], out=t[1:])

    def of(self, start: np.ndarray, stop: np.ndarray, k: int = 0) -> np.ndarray:
        t = self.total[k]
        return mix((t[stop] - t[start]) * self.down[k][start] + (stop - start).astype(np.uint64))


def _lowest(keys: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every `w` neighbours: running minima of blocks from both sides."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _segments(cut: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges to look at together: whole texts, or overlapping ranges of a long one."""
    n = len(cut) - 1
    i = 0
    while i < n:
        if cut[i + 1] - cut[i] > SEGMENT:
            at = cut[i]
            while True:
                stop = min(at + SEGMENT, cut[i + 1])
                yield at, stop
                if stop == cut[i + 1]:
                    break
                at = stop - length + 1
            i += 1
        else:
            j = int(np.searchsorted(cut, cut[i] + SEGMENT, side="right")) - 1
            yield cut[i], cut[j]
            i = j


def contexts_of(raw: np.ndarray, cut: np.ndarray, p: SuffixParameters) -> tuple[np.ndarray, ...]:
    """(row, first, last, anchor, key, digest): windows starting at first to last share the anchor; bytes of the text of the row."""
    out = []
    w = p.length - p.gram + 1
    for lo, hi in _segments(cut, p.length):
        n = hi - lo
        if n < p.length:
            continue
        hasher = _Hasher(raw[lo:hi])
        at = np.arange(n - p.gram + 1)
        keys = hasher.of(at, at + p.gram)
        low = np.uint64((1 << _POSITION) - 1)
        anchor = (_lowest((keys & ~low) | at.astype(np.uint64), w) & low).astype(np.int64)
        inner = cut[(cut > lo) & (cut < hi)] - lo
        crossing = np.zeros(len(anchor) + 1, dtype=np.int64)
        np.add.at(crossing, np.maximum(inner - p.length + 1, 0), 1)
        np.add.at(crossing, np.minimum(inner, len(anchor)), -1)
        valid = np.cumsum(crossing[:-1]) == 0
        new = np.ones(len(anchor), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchor)) - 1
        first, last = first[valid[first]], last[valid[first]]
        row = np.searchsorted(cut, first + lo, side="right") - 1
        shift = lo - cut[row]
        out.append((row, first + shift, last + shift, anchor[first] + shift, keys[anchor[first]], hasher.of(first, last + p.length, 1)))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*out))


def _parted(raw: np.ndarray, first: int, last: int, anchor: int, part: int, length: int) -> tuple[np.ndarray, ...]:
    """(first, last, key, digest) of the parts of a context: runs of windows whose anchor offset falls in one step of `part`."""
    data = raw[first : last + length]
    hasher = _Hasher(data)
    offset = anchor - np.arange(first, last + 1)
    step = offset // part
    new = np.ones(len(step), dtype=bool)
    new[1:] = step[1:] != step[:-1]
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(step)) - 1
    # all windows of a step cover these bytes
    core = anchor - first - step[a] * part
    inside = hasher.of(core, core - part + 1 + length)
    return a + first, b + first, mix(inside ^ (step[a].astype(np.uint64) + np.uint64(part << 20))), hasher.of(a, b + length, 1)


#: `place` holds the first window, the number of further ones and the distance of the anchor, in 44, 10 and 10 bits.
CONTEXT = "u1 long, u2 long, place long, key long, digest long"


def _place(first, last, anchor):
    return (first << 20) | ((last - first) << 10) | (anchor - first)


def _unplaced(place: int) -> tuple[int, int, int]:
    first = place >> 20
    return first, first + (place >> 10 & 1023), first + (place & 1023)


def _scan(docs: DataFrame, p: SuffixParameters) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                raw, cut = text_bytes(batch.column(2))
                row, first, last, anchor, key, digest = contexts_of(raw, cut, p)
                at = pa.array(row, pa.int64())
                signed = [pa.array(x.view(np.int64)) for x in (_place(first, last, anchor), key, digest)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *signed], names=[c.split()[0] for c in CONTEXT.split(", ")])

    return docs.select("u1", "u2", "text").mapInArrow(scan, CONTEXT)


def _squeezed(docs: DataFrame) -> DataFrame:
    """(u1, u2, text compressed): what is shuffled when texts have to meet spans."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([squeezed_text(x.as_py().encode()) for x in batch.column(batch.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=batch.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(shrink, f"{fields}, text binary")


def _repeated_keys(contexts: DataFrame) -> DataFrame:
    """Contexts whose key occurs twice or more."""
    keys = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return contexts.join(keys, "key", "left_semi")


def _fetch(docs: DataFrame, wanted: DataFrame, part: int, p: SuffixParameters) -> DataFrame:
    """Rows of `wanted` (CONTEXT, n) cut from their compressed texts, as (CONTEXT, n, bytes); cut into parts where `part` is smaller."""
    spans = wanted.groupBy("u1", "u2").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c not in ("u1", "u2")])).alias("spans"))
    joined = docs.select("u1", "u2", "text").join(spans, ["u1", "u2"])
    whole = part >= p.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, (text, spans) in enumerate(zip(batch.column(2), batch.column(3))):
                    data = np.frombuffer(unsqueezed_text(text.as_py()), dtype=np.uint8)
                    rows = []
                    for s in spans.as_py():
                        first, last, anchor = _unplaced(s["place"])
                        if whole:
                            rows.append((s["place"], s["key"], s["digest"], s["n"], data[first : last + p.length].tobytes()))
                        else:
                            for a, b, k, d in zip(*_parted(data, first, last, anchor, part, p.length)):
                                # the distance of the anchor may be that of a window after it; it is kept for the next cut
                                rows.append((_place(int(a), int(b), anchor), int(k.view(np.int64)), int(d.view(np.int64)), s["n"], b""))
                    arrays = [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])]
                    same = pa.array([i] * len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(same), batch.column(1).take(same), *arrays],
                        names=["u1", "u2", "place", "key", "digest", "n", "bytes"],
                    )

    return joined.mapInArrow(cut, CONTEXT + ", n long, bytes binary")


def _indexed(rows: DataFrame, p: SuffixParameters) -> DataFrame:
    """(u1, u2, start, stop) of the bytes under repeated strings among rows (u1, u2, first, key, n, bytes); keys meet in one task."""
    dealt = rows.select("key", "u1", "u2", F.shiftright("place", 20).alias("first"), "n", "bytes").repartition("key").sortWithinPartitions("key")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[tuple]) -> pa.RecordBatch:
            found = repeated_places([h[5] for h in held], np.array([h[4] for h in held], dtype=float), p.length)
            spans = [(h[1], h[2], h[3] + a, h[3] + b) for h, places in zip(held, found) for a, b in _runs(places, p.length)]
            columns = list(zip(*spans)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u1", "u2", "start", "stop"])

        # a key is added only if there is room for all of it; one key alone has at most `limit` contexts
        held: list[tuple] = []
        new: list[tuple] = []
        size = added = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                for row in zip(*(c.slice(lo, 1000).to_pylist() for c in batch.columns)):
                    if new and row[0] != new[0][0]:
                        if held and size + added > p.batch_bytes:
                            yield solve(held)
                            held, size = [], 0
                        held += new
                        size += added
                        new, added = [], 0
                    new.append(row)
                    added += len(row[5])
        if held and size + added > p.batch_bytes:
            yield solve(held)
            held = []
        held += new
        if held:
            yield solve(held)

    return dealt.mapInArrow(index, "u1 long, u2 long, start long, stop long")


def _runs(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges under the strings that start at sorted `places`."""
    if not len(places):
        return []
    first = np.append(True, places[1:] > places[:-1] + length)
    last = np.append(first[1:], True)
    return list(zip(places[first].tolist(), (places[last] + length).tolist()))


def repeated_spans(docs: DataFrame, p: SuffixParameters = SuffixParameters()) -> DataFrame:
    """(u1, u2, start, stop): byte ranges under repeated strings, which may overlap, of docs (u1, u2, text)."""
    found: DataFrame | None = None
    small_texts = _squeezed(docs)
    contexts = stored(_scan(docs, p)).withColumn("n", F.lit(1).cast("bigint"))
    for level, part in enumerate(p.parts):
        # from here a row is a context or a part; n > 1 stands for others like it that are decided already
        alive = stored(_repeated_keys(contexts))
        kinds = alive.groupBy("key", "digest").agg(
            F.sum("n").alias("n"), F.min(F.struct("u1", "u2", "place")).alias("one")
        )
        kinds = stored(kinds)
        many = kinds.where("n > 1").select("key", "digest")
        equal = alive.join(many, ["key", "digest"], "left_semi")
        first = F.shiftright("place", 20)
        windows = F.shiftright("place", 10).bitwiseAND(F.lit(1023))
        spans = equal.select("u1", "u2", first.alias("start"), (first + windows + p.length).alias("stop"))
        found = spans if found is None else found.unionByName(spans)
        several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        one = kinds.join(several, "key").select("key", "digest", "n", "kinds", "one.*")
        small = one.where(F.col("kinds") <= p.limit).drop("kinds")
        if part == 1:
            return found  # a part of one window: its digest has decided
        found = found.unionByName(stored(_indexed(_fetch(small_texts, small, p.parts[0], p), p)))
        large = one.where(F.col("kinds") > p.limit).drop("kinds")
        if not large.limit(1).count():
            return found
        contexts = stored(_fetch(small_texts, large, p.parts[level + 1], p).drop("bytes"))
    return found


def remove_repeated_bytes(
    docs: DataFrame, p: SuffixParameters = SuffixParameters(), id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of `docs`: the id, `n_bytes`, `spans` (removed byte ranges, maximal), `kept` (the other bytes, binary).

    A null text is an empty one. Repeated rows are each other's copies: all their strings go if they are long enough. Rows are
    told apart by two hashes of id and text, so ids may be null or repeat. Other columns of `docs` are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(id_column).alias("id"), t.alias("text"))
    base = base.select("id", F.xxhash64("id", "text").alias("u1"), F.xxhash64("text", "id", F.lit(7)).alias("u2"), "text")
    spans = repeated_spans(base.select("u1", "u2", "text"), p).groupBy("u1", "u2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = _squeezed(base).join(spans, ["u1", "u2"], "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for value, spans in zip(batch.column(1), batch.column(2)):
                data = unsqueezed_text(value.as_py())
                runs = merged([(s["start"], s["stop"]) for s in spans.as_py()]) if spans.is_valid else []
                n.append(len(data))
                gone.append([{"start": a, "stop": b} for a, b in runs])
                kept.append(b"".join(data[a:b] for a, b in apart(runs, len(data))))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    out = joined.mapInArrow(cut, f"id {kind}, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_column)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
