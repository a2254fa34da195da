"""Helpers shared by the corpus operators: words, hashes, stored intermediate tables, grouped tasks, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.session import ensure_checkpoint_dir

# The white space of the contracts, as a set for Python and for Java patterns.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, as a URI that every executor can open."""
    ensure_checkpoint_dir(spark)
    return f"{spark._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends here and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of unsigned 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_codec = pa.Codec("zstd", 1)


def squeezed(values: np.ndarray) -> bytes:
    """An array as compressed byte planes, with its length in front; small numbers in wide types shrink to almost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + (_codec.compress(planes, asbytes=True) if planes else b"")


def unsqueezed(blob: bytes, dtype: type) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    if not size:
        return np.zeros(0, dtype=dtype)
    planes = np.frombuffer(_codec.decompress(blob[8:], size, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def squeezed_text(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (_codec.compress(data, asbytes=True) if data else b"")


def unsqueezed_text(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return _codec.decompress(blob[8:], size, asbytes=True) if size else b""


def grouped(
    df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, partitions: int | None = None
) -> DataFrame:
    """Run `fn` on the rows of each key as one Arrow table; whole runs of keys share a task, so small groups cost little.

    The caller bounds the size of a group.
    """
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    columns = list(keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            arrays = [batch.column(names.index(c)) for c in columns]
            edges = np.zeros(batch.num_rows, dtype=bool)
            for a in arrays:
                v = a.to_numpy(zero_copy_only=False)
                edges[1:] |= v[1:] != v[:-1]
            starts = [0, *np.flatnonzero(edges).tolist(), batch.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                key = tuple(a[lo].as_py() for a in arrays)
                if held and key != last:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key
        if held:
            yield from fn(pa.Table.from_batches(held))

    return dealt.sortWithinPartitions(*keys).mapInArrow(cut, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable over `edges`, for every node that has an edge.

    Each round takes the smallest label among the neighbours and then the label of that label, so the rounds follow the
    logarithm of the longest path on usual graphs; a round ends in a stored table. There is no limit on rounds.
    Joins are on nodes; adaptive execution splits a node with very many edges.
    """
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    both = both.select("u", "v").unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.groupBy("u").agg(F.min("v").alias("m"))
    labels = stored(first.select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        near = (
            both.join(labels, both.v == labels.node)
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("m"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "m").alias("component")
        )
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = stored(
            lower.join(jump, "component", "left").select("node", "was", F.coalesce("next", "component").alias("component"))
        )
        moved = new.where("was <> component").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


# Fixed values of the word hash: any odd multiplier of 64 bits does; its inverse follows.
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SEGMENT = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Byte values and powers for the word hash; the powers grow with the longest segment met."""

    def __init__(self) -> None:
        lowered = np.arange(256, dtype=np.uint64)
        lowered[65:91] += np.uint64(32)
        self.value = {True: mix(lowered + np.uint64(1)), False: mix(np.arange(1, 257, dtype=np.uint64))}
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n + 1024), _powers(pow(_BASE, -1, 1 << 64), n + 1024)


_tables = _Tables()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying texts; a null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    cut = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[cut[0] : cut[-1]], cut - cut[0]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte, end byte) of every word of every text, in order; bytes count from the start of the column.

    A word's hash is a polynomial over its bytes (A-Z lower-cased if `lower`). Bytes are worked off in segments that end
    between words, so memory does not follow the length of a text.
    """
    raw, cut = text_bytes(column)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo, n = 0, len(raw)
    edge = np.unique(cut)
    while lo < n:
        hi = min(lo + _SEGMENT, n)
        while hi < n and not _tables.space[raw[hi - 1]]:  # up to a white space or the end of the text
            end = int(edge[np.searchsorted(edge, hi)])
            gap = np.flatnonzero(_tables.space[raw[hi : min(end, hi + _SEGMENT)]])
            hi = hi + int(gap[0]) + 1 if len(gap) else min(end, hi + _SEGMENT)
            if hi == end:
                break
        b = raw[lo:hi]
        _tables.reach(len(b))
        solid = ~_tables.space[b]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = edge[(edge > lo) & (edge < hi)] - lo
        first[inner] = solid[inner]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        last[inner - 1] = solid[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_tables.value[lower][b] * _tables.up[: len(b)], out=total[1:])
        out.append((mix((total[e] - total[s]) * _tables.down[s]), s + lo, e + lo))
        lo = hi
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    hashes, start, end = (np.concatenate(x) for x in zip(*out))
    return hashes, np.searchsorted(cut, start, side="right") - 1, start, end


def row_slices(rows: np.ndarray, n: int) -> np.ndarray:
    """Cuts of an array whose sorted `rows` run from 0 to n - 1: entries of row i are cuts[i] to cuts[i + 1]."""
    return np.searchsorted(rows, np.arange(n + 1))


def pieces_of(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text in `column`; a longer text stands alone."""
    _, cut = text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
