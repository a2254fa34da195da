"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

1. *Word vectors.* Every word falls into one of `buckets` by its hash and has a sparse ternary index vector. The context vector of
   a bucket is the sum of the index vectors around all its occurrences in all documents. A task sums whole numbers in one
   table of buckets x dims, tables are summed by ranges of buckets: the result does not depend on the dealing, and its size
   is fixed by the parameters.
2. *Documents.* Mean and spread of the unit context vectors of all words, and the logarithm of their number.
3. *Network.* Trained in the driver on at most `sample` labelled documents, those with the smallest hash of their id; a fifth of
   them, chosen by another hash, sets the temperature. Scores are one broadcast of the weights away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import grouped, pieces_of, row_slices, stored, word_hashes


@dataclass(frozen=True)
class ClassifierParameters:
    buckets: int = 1 << 15
    dims: int = 32
    nonzero: int = 4
    window: int = 2
    hidden: int = 32
    sample: int = 20_000
    epochs: int = 60
    batch: int = 256
    rate: float = 3e-3
    decay: float = 1e-4
    seed: int = 11

    @property
    def ranges(self) -> int:
        return max(1, self.buckets // 512)


def index_vectors(p: ClassifierParameters) -> np.ndarray:
    """(buckets, dims) with `nonzero` draws of +1 or -1 in each row, fixed by the seed."""
    rng = np.random.default_rng(p.seed)
    out = np.zeros((p.buckets, p.dims), dtype=np.int16)
    place = rng.integers(0, p.dims, (p.buckets, p.nonzero))
    sign = rng.choice(np.array([-1, 1], dtype=np.int16), (p.buckets, p.nonzero))
    np.add.at(out, (np.arange(p.buckets)[:, None], place), sign)
    return out


def _buckets(column: pa.Array, p: ClassifierParameters) -> tuple[np.ndarray, np.ndarray]:
    words, rows, _, _ = word_hashes(column, lower=False)
    return (words % np.uint64(p.buckets)).astype(np.int64), rows


def context_vectors(docs: DataFrame, p: ClassifierParameters, text: str = "text") -> np.ndarray:
    """(buckets, dims) sums over all documents; the driver gets buckets x dims numbers whatever the input."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors(p)
        total = np.zeros((p.buckets, p.dims), dtype=np.int64)
        for whole in batches:
            for batch in pieces_of(whole, 0, 1 << 20):
                bucket, rows = _buckets(batch.column(0), p)
                for lo in range(0, len(bucket), 1 << 17):
                    hi = min(lo + (1 << 17), len(bucket))
                    a, b = max(lo - p.window, 0), min(hi + p.window, len(bucket))
                    vectors, row = index[bucket[a:b]], rows[a:b]
                    around = np.zeros((b - a, p.dims), dtype=np.int32)
                    for k in range(1, p.window + 1):
                        same = (row[k:] == row[:-k])[:, None]
                        around[k:] += vectors[:-k] * same
                        around[:-k] += vectors[k:] * same
                    around, word = around[lo - a : hi - a], bucket[lo:hi]
                    order = np.argsort(word, kind="stable")
                    first = np.flatnonzero(np.append(True, np.diff(word[order]) > 0))
                    total[word[order][first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)
        parts = total.reshape(p.ranges, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(p.ranges), pa.int32()), pa.array([x.tobytes() for x in parts])], names=["part", "sums"])

    def add(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets // p.ranges * p.dims, dtype=np.int64)
        for value in rows["sums"]:
            total += np.frombuffer(value.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([rows["part"].combine_chunks()[:1], pa.array([total.tobytes()])], names=["part", "sums"])

    tables = docs.select(text).mapInArrow(scan, "part int, sums binary")
    summed = grouped(tables, ["part"], add, "part int, sums binary", p.ranges).collect()
    out = np.zeros((p.ranges, p.buckets // p.ranges * p.dims), dtype=np.int64)
    for row in summed:
        out[row["part"]] = np.frombuffer(row["sums"], dtype=np.int64)
    return out.reshape(p.buckets, p.dims)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (vectors / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, p: ClassifierParameters, text: str = "text") -> DataFrame:
    """`docs` without `text`, with `features`: mean, spread and log length; zeros for no words."""
    keep = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(unit_rows(vectors))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            at = whole.schema.names.index(text)
            for batch in pieces_of(whole, at, 1 << 20):
                bucket, rows = _buckets(batch.column(at), p)
                n = batch.num_rows
                cuts = row_slices(rows, n)
                count = np.diff(cuts)
                mean = np.zeros((n, p.dims), dtype=np.float64)
                square = np.zeros((n, p.dims), dtype=np.float64)
                some = np.flatnonzero(count)
                if len(some):
                    found = table[bucket]
                    mean[some] = np.add.reduceat(found, cuts[some], axis=0, dtype=np.float64)
                    square[some] = np.add.reduceat(found * found, cuts[some], axis=0, dtype=np.float64)
                size = np.maximum(count, 1)[:, None]
                mean /= size
                spread = np.sqrt(np.maximum(square / size - mean * mean, 0))
                features = np.concatenate([mean, spread, np.log1p(count)[:, None]], axis=1).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * features.shape[1], pa.int32()), pa.array(features.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), lists], names=[*keep, "features"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != text)
    return docs.mapInArrow(pool, fields + "features array<float>")


@dataclass
class Network:
    """Standardised features -> tanh layer -> logit / temperature; without training data a constant."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, check: np.ndarray, p: ClassifierParameters) -> Network:
    """Adam on the log loss of the rows not in `check`; `check` sets the temperature by a search over its log loss."""
    width = x.shape[1] if x.ndim == 2 else 2 * p.dims + 1
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    net = Network(np.zeros(width), np.ones(width), np.zeros((width, p.hidden)), np.zeros(p.hidden), np.zeros(p.hidden), base)
    if len(set(y.tolist())) < 2:
        return net
    fit = ~check if 0 < check.sum() < len(y) else np.ones(len(y), dtype=bool)
    rng = np.random.default_rng(p.seed)
    net.centre, net.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    net.w1 = rng.normal(0, 1 / np.sqrt(width), (width, p.hidden))
    net.w2 = rng.normal(0, 1 / np.sqrt(p.hidden), p.hidden)
    a, t = (x[fit] - net.centre) / net.scale, y[fit]
    weights = [net.w1, net.b1, net.w2, np.array([base])]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(p.epochs):
        order = rng.permutation(len(t))
        for lo in range(0, len(t), p.batch):
            xb, yb = a[order[lo : lo + p.batch]], t[order[lo : lo + p.batch]]
            h = np.tanh(xb @ weights[0] + weights[1])
            z = h @ weights[2] + weights[3][0]
            dz = (1 / (1 + np.exp(-z)) - yb) / len(yb)
            dh = dz[:, None] * weights[2] * (1 - h * h)
            slopes = [xb.T @ dh + p.decay * weights[0], dh.sum(axis=0), h.T @ dz + p.decay * weights[2], np.array([dz.sum()])]
            step += 1
            for w, g, m, v in zip(weights, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    held = check if 0 < check.sum() < len(y) else fit
    z = net.logits(x[held])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 141))
    net.temperature = float(grid[int(np.argmin([log_loss(z / g, y[held]) for g in grid]))])
    return net


def fold(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo `n`; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _below_cut(keyed: DataFrame, sample: int) -> Column:
    """Condition on `h` that leaves little more than the `sample` smallest hashes, from the counts of 65,536 ranges of hashes.

    Without it every task would send its own `sample` rows to the driver.
    """
    part = F.shiftright("h", 48)
    left = sample
    for r in sorted(keyed.groupBy(part.alias("r")).count().collect(), key=lambda r: r["r"]):
        left -= r["count"]
        if left <= 0:
            return part <= r["r"]
    return F.lit(True)


def quality_scores(
    docs: DataFrame, labels: DataFrame, p: ClassifierParameters = ClassifierParameters(), folds: int = 5, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, held_out, score) for every row of `docs`; labels (id, label 0 or 1) of fold 0 are not learned from.

    Null and empty texts have zero vectors and get the score of such a text. Without labels of both kinds all scores are the smoothed
    share of label 1. An id with several labels counts by their mean, from one half on as 1; ids repeated in `docs`, or null, are scored row
    by row. Only id and text are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    features = stored(pooled(rows, context_vectors(rows, p), p))
    known = labels.where("label is not null").groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    train_rows = features.join(known.where(fold("id", folds) != 0), "id")
    keyed = train_rows.withColumn("h", F.xxhash64("id", F.lit(p.seed)))
    picked = (
        keyed.where(_below_cut(keyed, p.sample)).orderBy("h", "id").limit(p.sample)
        .select("features", "label", (F.pmod("h", F.lit(5)) == 0).alias("check")).collect()
    )
    x = np.array([r["features"] for r in picked], dtype=np.float64).reshape(len(picked), 2 * p.dims + 1)
    net = train(x, np.array([r["label"] for r in picked], dtype=np.float64), np.array([r["check"] for r in picked], dtype=bool), p)
    shared = spark.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], names=["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    scored = features.select("id", "features").mapInArrow(score, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_column), (fold("id", folds) == 0).alias("held_out"), "score")
