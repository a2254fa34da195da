"""Hierarchical Pitman-Yor language model, trained and applied on all documents.

Restaurants: one for each class of the preceding word (1,024 classes by hash, one of them the start of a text), whose parents are
shared by 32 classes each, whose parent is the unigram restaurant, whose base is uniform over the training tokens and one for
all unknown ones. Customers are training tokens; a table of a restaurant is a customer of its parent.

Every word's seatings lie with the word, so words are dealt into buckets by hash and a bucket needs only the totals of each
restaurant from the sweep before (a few thousand numbers, summed over buckets). In a sweep all seatings of a word are sampled
anew by the Chinese-restaurant rule, given those totals and the parent's predictive probability. Predictive probabilities
of the last sweeps are averaged.

1. *Blocks.* A task turns some texts into the distinct words of the block, the distinct (word, class) pairs with their training
   counts, and for each text the pairs of its tokens. A hot word is one word with at most 1,024 pairs in a block.
2. *Buckets.* Words and pairs of all blocks meet by hash; sweeps run there; what a block needs to know about its words and
   pairs goes back: counts, tables and the unigram probability, not the tokens.
3. *Scores.* The answers of all buckets meet the block's texts.

The number of buckets is the session's number of shuffle partitions. Everything is seeded by bucket and sweep, so a lost task gives the
same numbers again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.classifier import fold
from traceframe.llm.common import grouped, pieces_of, row_slices, squeezed, stored, unsqueezed, word_hashes

END = 0x5851F42D4C957F2D


@dataclass(frozen=True)
class LanguageParameters:
    classes: int = 1024
    parents: int = 32
    sweeps: int = 3
    averaged: int = 2
    strength: float = 1.0
    block_bytes: int = 12 << 20
    seed: int = 3

    @property
    def per_parent(self) -> int:
        return self.classes // self.parents


# ---------------------------------------------------------------- blocks


@dataclass
class Block:
    words: np.ndarray  # distinct hashes, in order
    pairs_of_word: np.ndarray
    pair_class: np.ndarray
    pair_count: np.ndarray  # training occurrences
    token_pair: np.ndarray
    token_cuts: np.ndarray  # tokens of text i: cuts[i] to cuts[i + 1]


def block_of(column: pa.Array, training: np.ndarray, p: LanguageParameters) -> Block:
    hashes, rows, _, _ = word_hashes(column)
    n = len(column)
    cuts = row_slices(rows, n)
    count = np.diff(cuts)
    token_cuts = np.concatenate([[0], np.cumsum(count + 1)])
    tokens = np.full(token_cuts[-1], END, dtype=np.uint64)
    tokens[np.arange(len(hashes)) + rows] = hashes
    klass = np.zeros(len(tokens), dtype=np.int64)
    klass[1:] = 1 + ((tokens[:-1] >> np.uint64(17)) % np.uint64(p.classes - 1)).astype(np.int64)
    klass[token_cuts[:-1]] = 0
    words, word = np.unique(tokens, return_inverse=True)
    pairs, pair = np.unique(word * p.classes + klass, return_inverse=True)
    learned = np.repeat(training, count + 1)
    return Block(
        words,
        np.bincount(pairs // p.classes, minlength=len(words)).astype(np.uint16),
        (pairs % p.classes).astype(np.uint16),
        np.bincount(pair, weights=learned, minlength=len(pairs)).astype(np.uint32),
        pair.astype(np.uint32),
        token_cuts,
    )


def _blocks(batches: Iterator[pa.RecordBatch], p: LanguageParameters) -> Iterator[tuple[int, pa.RecordBatch, Block]]:
    """(block id, its rows, block) of batches (id, text, training); the id is unique in the job and the same in each run."""
    number = TaskContext.get().partitionId() << 24
    for whole in batches:
        for batch in pieces_of(whole, 1, p.block_bytes):
            training = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            yield number, batch, block_of(batch.column(1), training, p)
            number += 1


def _bucket_cuts(words: np.ndarray, buckets: int) -> np.ndarray:
    """Cuts of sorted hashes into buckets of equal ranges."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(words, edges), [len(words)]])


def _to_buckets(docs: DataFrame, buckets: int, p: LanguageParameters) -> DataFrame:
    """One stored row per bucket: the parts of all blocks that belong there."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, b in _blocks(batches, p):
            word_cuts = _bucket_cuts(b.words, buckets)
            pair_cuts = np.concatenate([[0], np.cumsum(b.pairs_of_word, dtype=np.int64)])[word_cuts]
            parts = [
                (i, *map(squeezed, (b.words[a:z], b.pairs_of_word[a:z], b.pair_class[c:d], b.pair_count[c:d])))
                for i, (a, z, c, d) in enumerate(zip(word_cuts[:-1], word_cuts[1:], pair_cuts[:-1], pair_cuts[1:]))
                if z > a
            ]
            bucket, *blobs = zip(*parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(parts), pa.int64()), pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)],
                names=["block", "bucket", "words", "pairs", "classes", "counts"],
            )

    def together(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by([("block", "ascending")]).combine_chunks()
        lists = [pa.array([rows[c].to_pylist()]) for c in ("block", "words", "pairs", "classes", "counts")]
        yield pa.RecordBatch.from_arrays([rows["bucket"].combine_chunks()[:1], *lists], names=["bucket", "block", "words", "pairs", "classes", "counts"])

    schema = "block long, bucket int, words binary, pairs binary, classes binary, counts binary"
    wide = "bucket int, block array<long>, words array<binary>, pairs array<binary>, classes array<binary>, counts array<binary>"
    return stored(grouped(docs.mapInArrow(scan, schema), ["bucket"], together, wide, buckets))


# ---------------------------------------------------------------- restaurants


@dataclass
class Totals:
    """Sums over all words: customers and tables of each restaurant, types with one and two customers at each level, tokens and types."""

    customers: list[np.ndarray]
    tables: list[np.ndarray]
    ones: np.ndarray
    twos: np.ndarray
    tokens: float
    types: float

    def flat(self) -> np.ndarray:
        return np.concatenate([*self.customers, *self.tables, self.ones, self.twos, [self.tokens, self.types]])

    @staticmethod
    def read(v: np.ndarray, p: LanguageParameters) -> Totals:
        sizes = [p.classes, p.parents, 1] * 2 + [3, 3]
        x = np.split(v, np.cumsum(sizes))
        return Totals(x[0:3], x[3:6], x[6], x[7], float(x[8][0]), float(x[8][1]))

    def discounts(self) -> np.ndarray:
        return np.clip(self.ones / np.maximum(self.ones + 2 * self.twos, 1), 0.05, 0.95)


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables for the customers of each dish, seated one after the other.

    With j seated at t tables the next one opens a table with weight `pull` (strength and discount times all tables of the restaurant,
    times the parent's probability of the dish) against j - discount t. Up to 16 customers this is drawn one by one,
    then in runs of a quarter of those seated, with the chance in the middle of the run.
    """
    tables = (customers > 0).astype(np.int64)
    j = 1
    live = np.flatnonzero(customers > j)
    while len(live):
        run = np.minimum(customers[live] - j, 1 if j < 16 else j // 4)
        chance = pull[live] / (pull[live] + j + (run - 1) / 2 - discount * tables[live])
        tables[live] += rng.binomial(run, np.clip(chance, 0, 1))
        j += 1 if j < 16 else j // 4
        live = live[customers[live] > j]
    return tables


class Seating:
    """All seatings of one bucket's words."""

    def __init__(self, words: np.ndarray, pair_word: np.ndarray, pair_class: np.ndarray, counts: np.ndarray, p: LanguageParameters):
        self.p, self.words, self.pair_word, self.pair_class, self.counts = p, words, pair_word, pair_class, counts
        group = pair_word * p.parents + pair_class // p.per_parent
        self.group_first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=np.int64)
        self.pair_group = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1 if len(group) else np.zeros(0, dtype=np.int64)
        self.group_word, self.group_parent = pair_word[self.group_first], pair_class[self.group_first] // p.per_parent
        self.word_first = np.flatnonzero(np.append(True, np.diff(self.group_word) > 0)) if len(group) else np.zeros(0, dtype=np.int64)
        self.tables = [(counts > 0).astype(np.int64), None, None]
        self._pass_up(None, None, None)

    def _sum(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, first) if len(first) else np.zeros(0, dtype=np.int64)

    def _pass_up(self, pulls, discounts, rng) -> None:
        """Customers and tables of the upper levels, given the tables of the lowest."""
        self.middle = self._sum(self.tables[0], self.group_first)
        self.tables[1] = (self.middle > 0).astype(np.int64) if rng is None else seat(self.middle, pulls[0], discounts[1], rng)
        self.top = self._sum(self.tables[1], self.word_first)
        self.tables[2] = (self.top > 0).astype(np.int64) if rng is None else seat(self.top, pulls[1], discounts[2], rng)

    def unigram(self, t: Totals, d: np.ndarray) -> np.ndarray:
        s, base = self.p.strength, 1 / (t.types + 1)
        return (self.top - d[2] * self.tables[2] + (s + d[2] * t.tables[2][0]) * base) / (s + t.customers[2][0])

    def shared(self, t: Totals, d: np.ndarray) -> np.ndarray:
        s, g = self.p.strength, self.group_parent
        own = self.middle - d[1] * self.tables[1]
        return (own + (s + d[1] * t.tables[1][g]) * self.unigram(t, d)[self.group_word]) / (s + t.customers[1][g])

    def sweep(self, t: Totals, rng: np.random.Generator) -> None:
        s, d = self.p.strength, t.discounts()
        uni, shared = self.unigram(t, d), self.shared(t, d)
        pull = (s + d[0] * t.tables[0][self.pair_class]) * shared[self.pair_group]
        self.tables[0] = seat(self.counts, pull, d[0], rng)
        pulls = ((s + d[1] * t.tables[1][self.group_parent]) * uni[self.group_word], np.full(len(uni), (s + d[2] * t.tables[2][0]) / (t.types + 1)))
        self._pass_up(pulls, d, rng)

    def totals(self) -> Totals:
        levels = (self.counts, self.middle, self.top)
        where = (self.pair_class, self.group_parent, np.zeros(len(self.top), dtype=np.int64))
        sizes = (self.p.classes, self.p.parents, 1)
        add = lambda v: [np.bincount(w, weights=x, minlength=n) for w, x, n in zip(where, v, sizes)]
        known = self._sum(self.counts, self.group_first)
        known = self._sum(known, self.word_first)
        ones, twos = (np.array([(x == k).sum() for x in levels], dtype=float) for k in (1, 2))
        return Totals(add(levels), add(self.tables), ones, twos, float(self.counts.sum()), float((known > 0).sum()))


def _merged(row: dict, p: LanguageParameters) -> tuple[Seating, list[tuple[np.ndarray, np.ndarray]]]:
    """The bucket's seating, and for each block the places of its words and pairs in it."""
    words = [unsqueezed(x, np.uint64) for x in row["words"]]
    all_words, at = np.unique(np.concatenate(words), return_inverse=True)
    cuts = np.cumsum([len(w) for w in words])[:-1]
    keys = [
        np.repeat(a, unsqueezed(n, np.uint16)) * p.classes + unsqueezed(c, np.uint16)
        for a, n, c in zip(np.split(at, cuts), row["pairs"], row["classes"])
    ]
    pairs, pair_at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unsqueezed(x, np.uint32) for x in row["counts"]])
    total = np.bincount(pair_at, weights=counts, minlength=len(pairs)).astype(np.int64)
    places = list(zip(np.split(at, cuts), np.split(pair_at, np.cumsum([len(k) for k in keys])[:-1])))
    return Seating(all_words, pairs // p.classes, pairs % p.classes, total, p), places


def _after(seating: Seating, bucket: int, totals: list[Totals], p: LanguageParameters) -> Iterator[int]:
    for k, t in enumerate(totals):
        seating.sweep(t, np.random.default_rng([p.seed, bucket, k]))
        yield k


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _sum_totals(parts: DataFrame, p: LanguageParameters) -> Totals:
    """Sum vectors (part, v) in tasks first; the driver gets at most 16 of some 2,000 numbers."""

    def add(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_buffer()) for x in rows["v"])
        yield pa.RecordBatch.from_arrays([rows["part"].combine_chunks()[:1], pa.array([total.tobytes()])], names=["part", "v"])

    got = grouped(parts, ["part"], add, "part int, v binary", 16).collect()
    size = 2 * (p.classes + p.parents + 1) + 8
    return Totals.read(sum((np.frombuffer(r["v"]) for r in got), np.zeros(size)), p)


def train(buckets: DataFrame, p: LanguageParameters) -> list[Totals]:
    """Totals before the first sweep and after each; job k repeats the sweeps before, whose state stays in the task."""
    known: list[Totals] = []
    for _ in range(p.sweeps):
        shared = buckets.sparkSession.sparkContext.broadcast(list(known))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                seating, _ = _merged(row, p)
                for _ in _after(seating, row["bucket"], shared.value, p):
                    pass
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["bucket"] % 16], pa.int32()), pa.array([seating.totals().flat().tobytes()])], names=["part", "v"]
                )

        known.append(_sum_totals(buckets.mapInArrow(measure, "part int, v binary"), p))
    return known


# ---------------------------------------------------------------- scores


def _answers(buckets: DataFrame, totals: list[Totals], p: LanguageParameters) -> DataFrame:
    """(block, bucket, known, unigram, pairs): for the block's words the training count and the averaged sweeps' unigram
    probability, for its pairs the customers and tables of both lower levels in each averaged sweep."""
    shared = buckets.sparkSession.sparkContext.broadcast(totals)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            seating, places = _merged(row, p)
            uni, state = [], []
            for k in _after(seating, row["bucket"], shared.value, p):
                if k >= p.sweeps - p.averaged:
                    t = shared.value[k]
                    uni.append(seating.unigram(t, t.discounts()).astype(np.float32))
                    g = seating.pair_group
                    state.append((seating.tables[0], seating.middle[g], seating.tables[1][g]))
            count = np.bincount(seating.pair_word, weights=seating.counts, minlength=len(seating.words))
            out = [
                (
                    block, row["bucket"], squeezed(count[w].astype(np.int64)), squeezed(np.concatenate([u[w] for u in uni])),
                    squeezed(np.concatenate([seating.counts[q], *(x[q] for s in state for x in s)])),
                )
                for block, (w, q) in zip(row["block"], places)
            ]
            block, bucket, *blobs = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)],
                names=["block", "bucket", "known", "unigram", "pairs"],
            )

    return buckets.mapInArrow(answer, "block long, bucket int, known binary, unigram binary, pairs binary")


def _texts(docs: DataFrame, p: LanguageParameters, kind: str) -> DataFrame:
    """(block, bucket = -1, ids, tokens, cuts, pairs_of_word, classes) of every block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch, b in _blocks(batches, p):
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([-1], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    *(pa.array([squeezed(x)], pa.binary()) for x in (b.token_pair, b.token_cuts, b.pairs_of_word, b.pair_class)),
                ],
                names=["block", "bucket", "ids", "tokens", "cuts", "pairs_of_word", "classes"],
            )

    return docs.mapInArrow(scan, f"block long, bucket int, ids array<{kind}>, tokens binary, cuts binary, pairs_of_word binary, classes binary")


def model_probabilities(klass: np.ndarray, word: np.ndarray, uni: np.ndarray, state: np.ndarray, totals: list[Totals], p: LanguageParameters) -> np.ndarray:
    """Predictive probability of each pair, averaged over the sweeps; uni: (sweeps, words), state: customers and three rows a sweep."""
    out = np.zeros(len(klass))
    parent = klass // p.per_parent
    s = p.strength
    customers = state[0]
    for k, (t, u) in enumerate(zip(totals, uni)):
        tables, middle, middle_tables = state[1 + 3 * k : 4 + 3 * k]
        d = t.discounts()
        up = (middle - d[1] * middle_tables + (s + d[1] * t.tables[1][parent]) * u[word]) / (s + t.customers[1][parent])
        out += (customers - d[0] * tables + (s + d[0] * t.tables[0][klass]) * up) / (s + t.customers[0][klass])
    return out / len(totals)


def language_scores(
    docs: DataFrame, p: LanguageParameters = LanguageParameters(), folds: int = 7, held: int = 2, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from rows whose crc32 of the id modulo `folds` is not `held`. Null and empty texts are one end token. Repeated rows are learned
    from as often as they occur and scored each. Without training rows all tokens are unknown and the uniform base decides.
    Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), (fold(id_column, folds) != held).alias("training"))
    dealt = _to_buckets(rows, buckets, p)
    totals = train(dealt, p)
    shared = spark.sparkContext.broadcast((totals[-p.averaged :], totals[0].tokens, totals[0].types))
    answers = _answers(dealt, totals, p)
    both = _texts(rows, p, kind).unionByName(answers, allowMissingColumns=True)

    def score(table: pa.Table) -> Iterator[pa.RecordBatch]:
        used, n_all, n_types = shared.value
        table = table.sort_by([("bucket", "ascending")])
        own, parts = table.slice(0, 1), table.slice(1)
        blob = lambda name, dtype: unsqueezed(own[name][0].as_py(), dtype)
        ids = own["ids"].combine_chunks().flatten()
        cuts, pairs = blob("cuts", np.int64), blob("tokens", np.uint32)
        klass = blob("classes", np.uint16).astype(np.int64)
        per_word = blob("pairs_of_word", np.uint16)
        word = np.repeat(np.arange(len(per_word)), per_word)
        answer = lambda name, dtype, rows: np.concatenate([unsqueezed(x.as_py(), dtype).reshape(rows, -1) for x in parts[name]], axis=1)
        k = len(used)
        known = answer("known", np.int64, 1)[0].astype(np.float64)
        uni = answer("unigram", np.float32, k)
        state = answer("pairs", np.int64, 1 + 3 * k)
        model = np.log10(model_probabilities(klass, word, uni, state, used, p))[pairs]
        seen = known[word][pairs]
        base = np.log10((seen + 1) / (n_all + n_types + 1))
        add = lambda v: np.add.reduceat(v, cuts[:-1])  # noqa: E731  every text has its end
        n = np.diff(cuts)
        total = add(model)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n), pa.array(add((seen > 0).astype(np.int64))), pa.array(add(base)), pa.array(total), pa.array(10 ** (-total / n))],
            names=["id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
        )

    scored = grouped(both, ["block"], score, f"id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")
    return scored.select(
        F.col("id").alias(id_column), (fold("id", folds) == held).alias("held_out"), "n_tokens", "n_known",
        F.lit(int(totals[0].tokens)).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity",
    )
