"""Hard negatives of anchor vectors: scores in blocks, then one secondary sort that a streaming iterator reads.

Vectors become whole numbers, so a score is exact. Rows and anchors are dealt over a grid of cells; a cell holds a bounded
block of anchors and reads its rows as a stream. It passes on the pairs that can still matter among its own rows: the best
of the anchor's label, or the best of other labels inside the window of any positive. Pairs are packed into keys of anchor,
descending score, kind and id, sorted within partitions, and read once: a positive opens its window, a negative fills the
windows that hold its score. Nothing is kept of an anchor but its open windows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import mix, stored

_KEY = struct.Struct(">QQQBQQ")
_SIGN = 1 << 63
_EXACT = 1 << 53  # sums of whole numbers below this are exact in a double
_CELLS = 1 << 22  # scores that a step holds at once


@dataclass(frozen=True)
class Mining:
    """A negative belongs to a positive if low * positive <= 100 * negative <= high * positive (scores, whole percents)."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    #: Rows and anchors of a cell of the grid.
    block_rows: int = 16384
    block_anchors: int = 4096

    def __post_init__(self) -> None:
        if not 0 <= self.low <= self.high <= 100:
            raise ValueError("a window lies below its positive: 0 <= low <= high <= 100")


def _whole(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, is_anchor, vec, size): vectors scaled and floored as 64-bit bytes, rows with a missing or non-finite part left out."""
    for batch in batches:
        lists = batch.column(3)
        lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
        flat = lists.flatten()
        lengths = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lengths)
        values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), lengths)
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(values * scale)
        fine = np.ones(len(lists), dtype=bool)
        fine[row[~np.isfinite(values)]] = False
        keep = fine & ~lists.is_null().to_numpy(zero_copy_only=False)
        size = np.zeros(len(lists))
        np.maximum.at(size, row, np.where(np.isfinite(values), np.abs(values), 0))
        if (size[keep] >= 2**62).any():
            raise ValueError("a scaled component does not fit 64 bits")
        with np.errstate(invalid="ignore"):
            whole = np.where(np.isfinite(values), values, 0).astype("<i8").tobytes()
        cut = np.concatenate([[0], np.cumsum(lengths)]) * 8
        blobs = [whole[cut[i] : cut[i + 1]] for i in np.flatnonzero(keep)]
        chosen = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays(
            [chosen.column(0), chosen.column(1), chosen.column(2), pa.array(blobs, pa.binary()), pa.array(size[keep].astype(np.int64))],
            names=["vec_id", "label", "is_anchor", "vec", "size"],
        )


class _Vectors:
    """Rows of vectors as one matrix, shorter vectors filled with zeros."""

    def __init__(self, blobs: Sequence[bytes], size: int) -> None:
        lengths = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
        self.width = int(lengths.max(initial=0))
        self.values = np.zeros((len(blobs), self.width), dtype=np.int64)
        inside = np.arange(self.width) < lengths[:, None]
        self.values[inside] = np.frombuffer(b"".join(blobs), dtype="<i8")
        self.size = size
        self.doubles = self.values.astype(np.float64)

    def scores(self, at: np.ndarray, other: _Vectors, there: np.ndarray) -> np.ndarray:
        """Inner products of the rows `at` with the rows `there` of `other`, exact."""
        width = min(self.width, other.width)
        bound = self.size * other.size * max(width, 1)
        if bound < _EXACT:
            return (self.doubles[at, :width] @ other.doubles[there, :width].T).astype(np.int64)
        if bound >= _SIGN:
            raise ValueError("scores do not fit 64 bits")
        return self.values[at, :width] @ other.values[there, :width].T


def _best(score: np.ndarray, ids: np.ndarray, floor: np.ndarray, mask: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n best entries of each row where `mask` holds and the score reaches `floor`; ties by the smaller id."""
    if score.shape[1] > n:
        low = np.where(mask, score, np.iinfo(np.int64).min)
        floor = np.maximum(floor, np.partition(low, score.shape[1] - n, axis=1)[:, score.shape[1] - n])
    i, j = np.nonzero(mask & (score >= floor[:, None]))
    order = np.lexsort((ids[j], -score[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < n], j[place < n]


class _Kept:
    """Best pairs of each (anchor, window) over the rows read so far."""

    def __init__(self, anchors: int, n: int) -> None:
        self.n = n
        self.slot = self.score = self.id = self.row = np.zeros(0, dtype=np.int64)
        self.floor = np.full(anchors, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(slot):
            return
        old = (self.slot, self.score, self.id, self.row)
        slot, score, ids, rows = (np.concatenate(x) for x in zip(old, (slot, score, ids, rows)))
        order = np.lexsort((rows, ids, -score, slot))
        slot, score, ids, rows = slot[order], score[order], ids[order], rows[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.n
        full = place == self.n - 1
        self.floor[slot[full]] = score[full]
        self.slot, self.score, self.id, self.row = slot[keep], score[keep], ids[keep], rows[keep]


def _cell_pairs(batches: Iterator[pa.RecordBatch], how: Mining) -> Iterator[pa.RecordBatch]:
    """Pairs that a cell passes on. Rows come sorted by cell, anchors first; `windows` of an anchor is null in the first pass."""
    cell, held, ready = None, [], None

    def flush() -> Iterator[pa.RecordBatch]:
        if ready is not None:
            yield from ready.out()

    for batch in batches:
        cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, len(cells)]):
            if lo == hi:
                continue
            if cells[lo] != cell:
                yield from flush()
                cell, held, ready = cells[lo], [], None
            part = batch.slice(lo, hi - lo)
            if kinds[lo] == 0:
                held.append(part)
                continue
            if not held:
                continue
            if ready is None:
                ready = _Cell(pa.Table.from_batches(held), how)
            for at in range(0, part.num_rows, 4096):
                ready.add(part.slice(at, 4096))
    yield from flush()


class _Cell:
    def __init__(self, anchors: pa.Table, how: Mining) -> None:
        self.how = how
        self.uid, self.id, self.label = (anchors.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        self.vectors = _Vectors(anchors.column("vec").to_pylist(), int(max(anchors.column("size").to_numpy(), default=0)))
        found = anchors.column("windows").to_pylist()
        self.first_pass = all(w is None for w in found)
        if self.first_pass:
            self.kept = [_Kept(len(self.uid), how.positives)]
            return
        least = np.iinfo(np.int64).min
        self.low = np.full((how.positives, len(self.uid)), 0, dtype=np.int64)
        self.high = np.full((how.positives, len(self.uid)), least, dtype=np.int64)
        for a, scores in enumerate(found):
            for w, p in enumerate(sorted({p for p in scores or [] if p >= 0}, reverse=True)):
                self.low[w, a], self.high[w, a] = -(-how.low * p // 100), how.high * p // 100
        self.kept = [_Kept(len(self.uid), how.negatives) for _ in range(how.positives)]

    def add(self, rows: pa.RecordBatch) -> None:
        names = rows.schema.names
        ids, labels, uids = (rows.column(names.index(c)).to_numpy() for c in ("vec_id", "label", "uid"))
        vectors = _Vectors(rows.column(names.index("vec")).to_pylist(), int(max(rows.column(names.index("size")).to_numpy())))
        step = max(1, _CELLS // len(ids))
        if self.first_pass:
            for label in np.unique(labels):
                there, every = np.flatnonzero(labels == label), np.flatnonzero(self.label == label)
                for lo in range(0, len(every), step):
                    at = every[lo : lo + step]
                    score = self.vectors.scores(at, vectors, there)
                    mask = self.id[at][:, None] != ids[there][None, :]
                    i, j = _best(score, ids[there], self.kept[0].floor[at], mask, self.how.positives)
                    self.kept[0].add(at[i], score[i, j], ids[there][j], uids[there][j])
            return
        for lo in range(0, len(self.uid), step):
            at = np.arange(lo, min(lo + step, len(self.uid)))
            score = self.vectors.scores(at, vectors, np.arange(len(ids)))
            other = self.label[at][:, None] != labels[None, :]
            for low, high, kept in zip(self.low[:, at], self.high[:, at], self.kept):
                live = np.flatnonzero(high >= low)
                if not len(live):
                    continue
                mask = other[live] & (score[live] <= high[live, None])
                i, j = _best(score[live], ids, np.maximum(low, kept.floor[at])[live], mask, self.how.negatives)
                kept.add(at[live][i], score[live[i], j], ids[j], uids[j])

    def out(self) -> Iterator[pa.RecordBatch]:
        pairs = np.stack([np.concatenate([getattr(k, c) for k in self.kept]) for c in ("slot", "score", "id", "row")])
        if len(self.kept) > 1 and pairs.size:
            pairs = np.unique(pairs, axis=1)  # windows overlap
        kind = 0 if self.first_pass else 1
        keys = [pair_key(self.id[s], self.uid[s], p, kind, i, r) for s, p, i, r in pairs.T.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])


def pair_key(anchor: int, uid: int, score: int, kind: int, other: int, row: int) -> bytes:
    """Bytes that sort by anchor, descending score, positives before negatives of the same score, then id and row."""
    return _KEY.pack(int(anchor) + _SIGN, int(uid), _SIGN - 1 - score, kind, other + _SIGN, row)


def key_parts(key: bytes) -> tuple[int, int, int, int, int, int]:
    anchor, uid, score, kind, other, row = _KEY.unpack(key)
    return anchor - _SIGN, uid, _SIGN - 1 - score, kind, other - _SIGN, row


def _anchor_of(key: bytes) -> int:
    return int(mix(np.frombuffer(key[8:16], dtype=">u8").astype(np.uint64))[0] >> np.uint64(33))


def sorted_pairs(pairs: DataFrame) -> RDD:
    """The packed keys, all of an anchor in one partition and in order."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.rdd.map(lambda row: (bytes(row[0]), None)).repartitionAndSortWithinPartitions(parts, _anchor_of).keys()


def first_positives(keys: Iterator[bytes], n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor, uid, score, id, row) of the first n pairs of each anchor."""
    last, seen = None, 0
    for key in keys:
        anchor, uid, score, _, other, row = key_parts(key)
        seen = seen + 1 if (anchor, uid) == last else 1
        last = anchor, uid
        if seen <= n:
            yield anchor, uid, score, other, row


def windowed_negatives(keys: Iterator[bytes], how: Mining) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) from keys in order.

    A window opens with its positive and holds a count alone. Scores fall, so a window whose lower end has passed is closed.
    """
    last: tuple[int, int] | None = None
    windows: list[list[int]] = []
    for key in keys:
        anchor, uid, score, kind, other, _ = key_parts(key)
        if (anchor, uid) != last:
            last, windows = (anchor, uid), []
        if kind == 0:
            windows.append([other, score, 0])
            continue
        open_still = []
        for w in windows:
            if 100 * score < how.low * w[1] or w[2] == how.negatives:
                continue
            open_still.append(w)
            if 100 * score <= how.high * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], other, w[1], score
        windows = open_still


def _dealt(rows: DataFrame, anchors: DataFrame, how: Mining, counts: tuple[int, int]) -> DataFrame:
    """Every row beside every block of anchors, cell by cell, anchors first."""
    down, across = (max(1, -(-n // size)) for n, size in zip(counts, (how.block_rows, how.block_anchors)))
    columns = ("uid", "vec_id", "label", "vec", "size", "windows")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = rows.withColumn("windows", F.lit(None).cast("array<bigint>")).withColumn("__r", (F.xxhash64("uid") % down + down) % down)
    a = anchors.withColumn("__s", (F.xxhash64("uid") % across + across) % across)
    cells = [
        a.withColumn("__r", every(down)).select((F.col("__r") * across + F.col("__s")).cast("bigint").alias("cell"), F.lit(0).alias("kind"), *columns),
        r.withColumn("__s", every(across)).select((F.col("__r") * across + F.col("__s")).cast("bigint").alias("cell"), F.lit(1).alias("kind"), *columns),
    ]
    dealt = cells[0].unionByName(cells[1]).repartition(min(down * across, 100_000), "cell")
    return dealt.sortWithinPartitions("cell", "kind").mapInArrow(partial(_cell_pairs, how=how), "key binary")


def hard_negatives(rows: DataFrame, how: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `rows` (vec_id, label, embedding, is_anchor).

    Scores are inner products of floor(scale * component), exact; higher ones come first, ties by the smaller id. An anchor's
    positives are its first rows of the same label, its negatives the first rows of other labels inside each positive's window.
    Rows with a null id, label, vector or component, or a non-finite component take no part. Vectors of other lengths are
    compared as far as both reach. Each repeated row counts; rows with the anchor's own id are never its partners, and an
    anchor that is there twice is searched twice. Further columns do not matter. Without rows or anchors the result is empty.
    """
    spark = rows.sparkSession
    fit = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    fit = fit.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("is_anchor").cast("boolean"), F.col("embedding").cast("array<double>"))
    whole = fit.mapInArrow(partial(_whole, scale=how.scale), "vec_id bigint, label bigint, is_anchor boolean, vec binary, size bigint")
    base = stored(whole.withColumn("uid", F.monotonically_increasing_id()))
    counts = base.agg(F.count("*"), F.count_if("is_anchor")).first()
    anchors = base.where("is_anchor")
    first = _dealt(base, anchors.withColumn("windows", F.lit(None).cast("array<bigint>")), how, counts)
    found = sorted_pairs(first).mapPartitions(partial(first_positives, n=how.positives))
    positives = stored(spark.createDataFrame(found, "anchor bigint, uid bigint, score bigint, other bigint, row bigint", verifySchema=False))
    scores = positives.groupBy("uid").agg(F.collect_list("score").alias("windows"))  # at most `positives` of an anchor
    second = _dealt(base, anchors.join(scores, "uid"), how, counts)
    opened = positives.rdd.map(lambda r: (bytearray(pair_key(r.anchor, r.uid, r.score, 0, r.other, r.row)),))
    opening = spark.createDataFrame(opened, "key binary", verifySchema=False)
    out = sorted_pairs(second.unionAll(opening)).mapPartitions(partial(windowed_negatives, how=how))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.createDataFrame(out, schema, verifySchema=False)
