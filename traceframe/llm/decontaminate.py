"""Benchmark decontamination by latent semantic retrieval.

1. Texts are cut into passages of 2 x `half` words that overlap by `half`. Only words of the benchmark count: no other word
   can bring a passage closer to an item. Weights are term frequency times the logarithm of the inverse passage frequency.
2. The latent space comes from a randomised decomposition: one pass over all passages sums (A'A) times a random matrix in every
   task, tasks are added up, and the driver finishes on a matrix of benchmark words x dimensions (Nystroem). The items'
   own rows join with a weight that puts their span into the space, so projecting never makes an item harder to find.
3. Every passage is projected and compared with every item by cosine. A passage above `cosine` is a candidate.
4. Candidates are decided on words: longest common subsequence of the item and the text around the passage, and of the item's
   answer (its last sentence unless given).

The benchmark is taken in blocks of `block_items`; what is broadcast is bounded by a block's words times dimensions, not by the
documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import grouped, pieces_of, row_slices, stored, word_hashes


@dataclass(frozen=True)
class LatentParameters:
    half: int = 32
    extra: int = 48
    cosine: float = 0.4
    verbatim: float = 0.8
    paraphrase: float = 0.5
    answer: float = 0.8
    block_items: int = 512
    seed: int = 5


@dataclass
class Items:
    """A block of the benchmark: ids, words of each item, where its answer begins, and the vocabulary."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]

    def __post_init__(self) -> None:
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *self.words]))
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def terms(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are in the vocabulary, and their terms."""
        place = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.vocabulary, hashes[place]), max(len(self.vocabulary) - 1, 0))
        hit = self.vocabulary[found] == hashes[place] if len(self.vocabulary) else np.zeros(0, dtype=bool)
        return place[hit], found[hit]


def items_of(rows: list[tuple]) -> Items:
    """(id, text, answer or null) rows; the answer of an item without one is its last sentence."""
    texts = [t or "" for _, t, _ in rows]
    answers = [a if a is not None else (re.split(r"(?<=[.!?])[\x20\x09-\x0D]+", t.strip("\x20\x09\x0a\x0b\x0c\x0d")) or [""])[-1] for t, (_, _, a) in zip(texts, rows)]

    def words(values: list[str]) -> list[np.ndarray]:
        hashes, row, _, _ = word_hashes(pc.utf8_lower(pa.array(values, pa.string())))
        cuts = row_slices(row, len(values))
        return [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    return Items([i for i, _, _ in rows], words(texts), words(answers))


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with the column of the recurrence as the bits of one number."""
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    column = full
    for w in b.tolist():
        match = where.get(w)
        if match:
            hit = column & match
            column = ((column + hit) | (column - hit)) & full
    return len(a) - column.bit_count()


def _passages(batch: pa.RecordBatch, column: int, size: int) -> tuple[np.ndarray, ...]:
    """(hashes, rows, passage of each word, first word of each passage): disjoint runs of `size` lower-cased words of one text."""
    hashes, rows, _, _ = word_hashes(pc.utf8_lower(batch.column(column)))
    cuts = row_slices(rows, batch.num_rows)
    place = np.arange(len(hashes)) - cuts[rows]
    new = place % size == 0
    return hashes, rows, np.cumsum(new) - 1, np.flatnonzero(new)


def _dense(passage: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, step: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first passage, terms used, passages x those terms) of `step` passages at a time, from entries in order of passage.

    A product of small dense matrices is several times faster than sums over gathered rows.
    """
    for lo in range(0, n, step):
        a, b = np.searchsorted(passage, [lo, lo + step])
        if b > a:
            used, column = np.unique(term[a:b], return_inverse=True)
            rows = min(step, n - lo)
            cell = (passage[a:b] - lo) * len(used) + column
            yield lo, used, np.bincount(cell, weights=value[a:b], minlength=rows * len(used)).reshape(rows, -1).astype(np.float32)


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of arrays (part, v), first in tasks by part; the driver gets at most 16 arrays of this shape."""

    def add(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(np.prod(shape)))
        for x in rows["v"]:
            total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([rows["part"].combine_chunks()[:1], pa.array([total.tobytes()])], names=["part", "v"])

    out = np.zeros(shape)
    for row in grouped(parts, ["part"], add, "part int, v binary", 16).toLocalIterator():
        out += np.frombuffer(row["v"]).reshape(shape)
    return out


def _accumulate(docs: DataFrame, shape: tuple[int, ...], add) -> np.ndarray:
    """Sum over all batches of what `add(total, batch)` adds to an array; one array leaves each task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for whole in batches:
            for batch in pieces_of(whole, 1, 1 << 20):
                add(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([total.tobytes()])], names=["part", "v"])

    return _summed(docs.mapInArrow(scan, "part int, v binary"), shape)


def weights_of(docs: DataFrame, items: Items, p: LatentParameters) -> np.ndarray:
    """Logarithm of the inverse passage frequency of the benchmark's words over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    terms = len(items.vocabulary)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        hashes, _, passage, first = _passages(batch, 1, 2 * p.half)
        place, term = shared.value.terms(hashes)
        total[:terms] += np.bincount(np.unique(passage[place] * terms + term) % terms, minlength=terms)
        total[terms] += len(first)

    counts = _accumulate(docs, (terms + 1,), add)
    return np.log((1 + counts[terms]) / (1 + counts[:terms])) + 1e-3


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def item_rows(items: Items, weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(items.words), len(weight)))
    for row, words in zip(out, items.words):
        np.add.at(row, np.searchsorted(items.vocabulary, words), 1)
    return unit(out * weight)


def latent_space(docs: DataFrame, items: Items, weight: np.ndarray, p: LatentParameters) -> np.ndarray:
    """(terms, dimensions) orthonormal: the leading right singular vectors of all passages and the heavily weighted items."""
    terms = len(weight)
    wide = min(terms, len(items.words) + p.extra)
    test = np.random.default_rng(p.seed).normal(size=(terms, wide)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((items, weight, test))

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        items, weight, test = shared.value
        y = total[:-1].reshape(terms, wide)
        hashes, _, passage, first = _passages(batch, 1, 2 * p.half)
        place, term = items.terms(hashes)
        keys, times = np.unique(passage[place] * terms + term, return_counts=True)
        passage, term = keys // terms, keys % terms
        value = times * weight[term]
        length = np.sqrt(np.bincount(passage, weights=value * value, minlength=len(first)))
        value = (value / np.maximum(length[passage], 1e-12)).astype(np.float32)
        total[-1] += len(first)
        for _, used, rows in _dense(passage, term, value, len(first)):
            y[used] += rows.T @ (rows @ test[used])

    flat = _accumulate(docs, (terms * wide + 1,), add)
    sketch = flat[:-1].reshape(terms, wide)
    own = item_rows(items, weight)
    test = test.astype(float)
    sketch += (flat[-1] + 1) * own.T @ (own @ test)
    shift = np.sqrt(terms) * np.finfo(float).eps * max(np.linalg.norm(sketch), 1e-12)
    core = test.T @ sketch + shift * test.T @ test
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-12
    half = (sketch + shift * test) @ (vectors[:, good] / np.sqrt(values[good]))
    return np.linalg.svd(half, full_matrices=False)[0]


FOUND = "item int, cosine double, lcs_ratio double, answer_ratio double"


def search(docs: DataFrame, items: Items, weight: np.ndarray, space: np.ndarray, p: LatentParameters) -> DataFrame:
    """Candidates above the cosine with their ratios: (id, FOUND)."""
    kind = docs.schema["id"].dataType.simpleString()
    projected = (space * weight[:, None]).astype(np.float32)
    targets = unit(item_rows(items, weight) @ space).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((items, projected, targets))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, projected, targets = shared.value
        for whole in batches:
            for batch in pieces_of(whole, 1, 1 << 20):
                hashes, rows, block, first = _passages(batch, 1, p.half)
                place, term = items.terms(hashes)
                cuts = row_slices(rows, batch.num_rows)
                z = np.zeros((len(first) + 1, projected.shape[1]), dtype=np.float32)
                for lo, used, counts in _dense(block[place], term, np.ones(len(term)), len(first)):
                    z[lo : lo + len(counts)] = counts @ projected[used]
                pair = np.append(rows[first[1:]] == rows[first[:-1]], False)
                both = z[:-1] + z[1:] * pair[:, None]
                hits: list[tuple] = []
                for lo in range(0, len(first), 4096):
                    near = unit(both[lo : lo + 4096]) @ targets.T
                    for i, k in zip(*np.nonzero(near >= p.cosine)):
                        row, item = rows[first[lo + i]], items.words[k]
                        a = max(first[lo + i] - len(item), cuts[row])
                        b = min(first[lo + i] + 2 * p.half + len(item), cuts[row + 1])
                        around, answer = hashes[a:b], items.answers[k]
                        ratio = common_length(item, around) / len(item) if len(item) else 0.0
                        told = common_length(answer, around) / len(answer) if len(answer) else 0.0
                        hits.append((row, k, float(near[i, k]), ratio, told))
                if hits:
                    row, *columns = zip(*hits)
                    kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                        names=["id", "item", "cosine", "lcs_ratio", "answer_ratio"],
                    )

    return docs.mapInArrow(scan, f"id {kind}, {FOUND}")


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, p: LatentParameters = LatentParameters(), id_column: str = "doc_id", text: str = "text",
    item_column: str = "item_id", item_text: str = "text", answer: str | None = None,
) -> DataFrame:
    """One row for each document and item it leaks: both ids, best `cosine`, `lcs_ratio`, `answer_ratio`.

    A leak has `lcs_ratio` >= verbatim, or >= paraphrase with `answer_ratio` >= answer. Null and empty texts and items without a word leak
    nothing. Rows that repeat an id count as one document; an item given twice is found under each of its ids. An empty table on
    either side gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    bench = benchmark.select(
        F.col(item_column).alias("i"), F.col(item_text).alias("t"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")
    )
    blocks = max(1, -(-bench.count() // p.block_items))
    numbered = bench.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    item_kind = benchmark.schema[item_column].dataType.simpleString()
    found: DataFrame | None = None
    for k in range(blocks):
        picked = numbered.where(F.col("block") == k).orderBy("i", "t").collect()  # about block_items rows
        items = items_of([(r["i"], r["t"], r["a"]) for r in picked])
        if not len(items.vocabulary):
            continue
        weight = weights_of(rows, items, p)
        hits = search(rows, items, weight, latent_space(rows, items, weight, p), p)
        leak = (F.col("lcs_ratio") >= p.verbatim) | ((F.col("lcs_ratio") >= p.paraphrase) & (F.col("answer_ratio") >= p.answer))
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {item_kind}")
        part = stored(hits.where(leak)).join(F.broadcast(names), "item").drop("item")
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = docs.schema[id_column].dataType.simpleString()
        found = spark.createDataFrame([], f"id {kind}, cosine double, lcs_ratio double, answer_ratio double, item_id {item_kind}")
    best = found.groupBy("id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "lcs_ratio", "answer_ratio")])
    return best.withColumnsRenamed({"id": id_column, "item_id": item_column})
