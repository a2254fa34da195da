"""Near-duplicate documents: MinHash bands for candidates, odd sketches for estimates, full shingle sets for the decision.

1. Each text becomes a set of word shingles (64-bit hashes), from it a digest of the set, MinHash samples in bands and the
   odd sketch of the samples: a bitmap whose bits are flipped by each sample, so that the population count of two
   XORed bitmaps estimates a high similarity. Texts are read in Arrow batches; nothing else leaves the task.
2. Equal sets form a class, told by the digest. Only the smallest id of a class goes on.
3. Classes that share a band value are tied to the smallest of them. The components of these ties are groups in which every
   candidate pair lies; copies and near copies in thousands cost one tie per document and band.
4. A group's texts meet in one task (a large group in several, one for each pair of blocks). There pairs are dropped by their
   sketches and the rest decided on full sets; pairs already connected need no decision. Only a tree of links leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import components, grouped, mix, pieces_of, row_slices, stored, word_hashes


@dataclass(frozen=True)
class NearDup:
    """Links need 100 * intersection >= percent * union.

    With 48 bands of 8 samples a pair of similarity 0.85 stays unseen with a chance of 2 in 10 million, one of 0.8 with 1 in
    7,000; lower `percent` wants fewer rows a band. `slack` is taken from the similarity before the sketch may drop a
    pair: six standard deviations of its estimate.
    """

    percent: int = 85
    shingle: int = 5
    bands: int = 48
    rows: int = 8
    bits: int = 1024
    slack: float = 0.15
    block_docs: int = 4_000
    block_shingles: int = 8_000_000

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def most_odd_bits(self) -> float:
        """Population count above which a pair is too unlike."""
        apart = 2 * self.samples * (1 - max(self.percent / 100 - self.slack, 0.0))
        return self.bits / 2 * (1 - np.exp(-2 * apart / self.bits))


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than `size` are one shingle, no word gives an empty set."""
    words, rows, _, _ = word_hashes(column)
    n = len(words)
    factor = np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        chain = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
        for k in range(size):
            chain = chain * factor + words[k : k + len(chain)]
    chain = mix(chain)
    cuts = row_slices(rows, len(column))
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(chain[lo : hi - size + 1]))
        else:
            short = 0
            for w in words[lo:hi].tolist():
                short = (short * 0xC2B2AE3D27D4EB4F + w + 1) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([short] if hi > lo else [], dtype=np.uint64)))
    return out


class _Signer:
    def __init__(self, p: NearDup):
        self.p = p
        seeds = mix(np.arange(1, p.samples + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
        self.seeds = (seeds >> np.uint64(32)).astype(np.uint32)[:, None]
        self.band_seeds = mix(np.arange(1, p.bands + 1, dtype=np.uint64))
        self.sample_seeds = seeds

    def samples(self, s: np.ndarray) -> np.ndarray:
        """Smallest value of every hash function over the set; worked in blocks that stay in the cache."""
        x = (s ^ (s >> np.uint64(32))).astype(np.uint32)[None, :]
        low = np.full(self.p.samples, 0xFFFFFFFF, dtype=np.uint32)
        width = min(x.shape[1], 1 << 16)
        step = max(1, (1 << 16) // width)
        for at in range(0, x.shape[1], width):
            for j in range(0, self.p.samples, step):
                y = x[:, at : at + width] ^ self.seeds[j : j + step]
                y *= np.uint32(0x9E3779B1)
                y ^= y >> np.uint32(15)
                y *= np.uint32(0x85EBCA77)
                np.minimum(low[j : j + step], y.min(axis=1), out=low[j : j + step])
        return low

    def sign(self, s: np.ndarray) -> tuple[int, int, np.ndarray, bytes]:
        with np.errstate(over="ignore"):
            d = (int(mix(s ^ np.uint64(0x51)).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0xA7)).sum(dtype=np.uint64)))
            low = self.samples(s).astype(np.uint64)
            band = self.band_seeds.copy()
            for column in low.reshape(self.p.bands, self.p.rows).T:
                band = mix(band * np.uint64(0xD6E8FEB86659FD93) + column)
            spot = mix(self.sample_seeds + low) % np.uint64(self.p.bits)
        odd = np.bincount(spot.astype(np.int64), minlength=self.p.bits) & 1
        return *d, band.view(np.int64), np.packbits(odd.astype(np.uint8)).tobytes()


def signatures(docs: DataFrame, p: NearDup, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, n_shingles, d1, d2, bands, sketch) of every row, `h` a hash of its text; bands and sketch are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(p)
        for whole in batches:
            for batch in pieces_of(whole, 2):
                rows = [(len(s), *(signer.sign(s) if len(s) else (0, 0, None, None))) for s in shingle_sets(batch.column(2), p.shingle)]
                n, d1, d2, bands, sketch = map(list, zip(*rows))
                signed = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), signed(d1), signed(d2), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["id", "h", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, h long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).mapInArrow(sign, schema)


def _links(table: pa.Table, p: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows and of the smallest row each is connected with, through exact links inside the table.

    Rows are ordered by id; those of one id are connected from the start.
    """
    n = table.num_rows
    block = table["block"].to_numpy()
    across = table["i"][0].as_py() != table["j"][0].as_py()
    bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint64).reshape(n, -1)
    sets: list[np.ndarray] = []
    for piece in table.select(["text"]).combine_chunks().to_batches():
        for small in pieces_of(piece, 0):
            sets.extend(shingle_sets(small.column(0), p.shingle))
    sizes = np.array([len(s) for s in sets])
    ids = table["id"].to_numpy()
    root = np.searchsorted(ids, ids)
    most = p.most_odd_bits()
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        later = later[root[later] != root[i]]
        if across:
            later = later[block[later] != block[i]]
        # sizes alone bound the similarity
        least, large = np.minimum(sizes[later], sizes[i]), np.maximum(sizes[later], sizes[i])
        later = later[100 * least >= p.percent * large]
        later = later[np.bitwise_count(bits[later] ^ bits[i]).sum(axis=1) <= most]
        for lo in range(0, len(later), 256):
            near = later[lo : lo + 256]
            near = near[root[near] != root[i]]
            if not len(near):
                continue
            joined = np.concatenate([sets[j] for j in near])
            spot = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
            edge = np.concatenate([[0], np.cumsum(sizes[near])[:-1]])
            both = np.add.reduceat((sets[i][spot] == joined).astype(np.int64), edge)
            for j in near[100 * both >= p.percent * (sizes[near] + sizes[i] - both)]:
                if root[j] != root[i]:
                    a, b = min(root[j], root[i]), max(root[j], root[i])
                    root[root == b] = a
    return np.arange(n), root


def near_duplicates(
    docs: DataFrame, p: NearDup = NearDup(), id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of `docs`: the id, `n_shingles`, `component_id` (smallest id reachable over links), `kept`.

    Nulls, empty texts and texts without a word have no shingle and are linked with nothing. A null id is linked with
    nothing, has no component and is kept. Rows that repeat an id are one node: their links are joined. Other columns of `docs` are
    not read, so their names do not matter. An empty table gives an empty result.
    """
    signed = stored(signatures(docs, p, id_column, text))
    full = signed.where("n_shingles > 0 and id is not null")
    classes = stored(full.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep")))
    reps = full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    values = reps.select("id", F.explode("bands").alias("band"))
    pivots = values.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot <> top")
    ties = values.join(pivots, "band").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    groups = components(ties)

    nodes = groups.join(full, groups.node == full.id).select("id", "h", "component", "n_shingles", "sketch")
    nodes = nodes.dropDuplicates(["id", "h"])
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    blocks = F.greatest(F.ceil(F.col("n") / p.block_docs), F.ceil(F.col("w") / p.block_shingles)).cast("int")
    nodes = nodes.join(sizes.select("component", blocks.alias("blocks")), "component")
    nodes = nodes.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).where("id is not null")
    rows = nodes.join(texts, ["id", "h"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "blocks", "id", "sketch", "text"
    )

    def link(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by([("id", "ascending")]).combine_chunks()
        at, root = _links(table, p)
        ids = table["id"].combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at)), ids.take(pa.array(root)), table["blocks"].combine_chunks()], names=["id", "root", "blocks"]
        )

    kind = docs.schema[id_column].dataType.simpleString()
    # `i` and `j` belong to the key, so a large group is dealt over many tasks
    trees = stored(grouped(rows, ["component", "i", "j"], link, f"id {kind}, root {kind}, blocks int"))
    # groups of one block are decided; those of several meet again
    split = components(trees.where("blocks > 1").select(F.col("id").alias("a"), F.col("root").alias("b")))
    whole = trees.where("blocks = 1").groupBy(F.col("id").alias("rep")).agg(F.min("root").alias("label"))
    labels = whole.unionByName(split.select(F.col("node").alias("rep"), F.col("component").alias("label")))
    member = signed.select("id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2", "n_shingles"], "left")
    member = member.withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))).join(labels, "rep", "left")
    member = stored(member.select("id", "n_shingles", F.coalesce("label", "rep").alias("label")))
    # rows of a repeated id may have got several labels: these are one
    several = member.where("id is not null").groupBy("id").agg(F.min("label").alias("least"), F.max("label").alias("top")).where("least <> top")
    several = stored(member.join(several, "id").select(F.col("label").alias("a"), F.col("least").alias("b")))
    if several.limit(1).count():
        joined = components(several).withColumnRenamed("node", "label")
        member = member.join(joined, "label", "left").withColumn("label", F.coalesce("component", "label"))
    component = F.col("label")
    return member.select(
        F.col("id").alias(id_column), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
