"""Repeated lines, sentences and passages: global digests, the earliest occurrence stays, the rest goes, original offsets are kept.

Units are lines, and within a line sentences; a sentence of more than `long_sentence` words is cut further after words
chosen by their hash. Of these, units with fewer than `min_words` words are left alone. A passage that lies anywhere in other
text, or is made of short lines or sentences, is found by runs: words that have the smallest hash of some `window` words in a row
are marks, and from every mark a run goes to the mark `run_marks` later, or to a later one that makes it `min_words` long. All
windows inside a passage choose the same marks wherever it lies, so in a repeated passage of more than 50 words only fewer than
`window` words at each end lie outside its common marks, and these hold a run. A unit is normalised by its words: A-Z lower-cased, white space of any length alike. Its
digest has 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.llm.common import mix, pieces_of, text_bytes, word_hashes


@dataclass(frozen=True)
class UnitParameters:
    min_words: int = 8
    long_sentence: int = 40
    cut_one_in: int = 16
    window: int = 8
    run_marks: int = 4


def _digests(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the word runs [first, last)."""
    out = []
    for factor in (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25):
        inverse = pow(factor, -1, 1 << 64)
        up = np.full(len(words) + 1, factor, dtype=np.uint64)
        down = np.full(len(words) + 1, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up[:-1])])
            out.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
    return out[0], out[1]


def marks(words: np.ndarray, rows: np.ndarray, window: int) -> np.ndarray:
    """Positions of the words with the smallest hash of some `window` words in a row of one text."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = words[:n].copy()
    for k in range(1, window):
        np.minimum(low, words[k : k + n], out=low)
    # a window over the edge of a text chooses nothing
    low[rows[:n] != rows[window - 1 :]] = 0
    high = np.zeros(len(words), dtype=np.uint64)
    for k in range(window):
        np.maximum(high[k : k + n], low, out=high[k : k + n])
    return np.flatnonzero(high == words)


def _runs(words: np.ndarray, rows: np.ndarray, p: UnitParameters) -> tuple[np.ndarray, np.ndarray]:
    """[first, last) in words of the runs between marks."""
    mark = marks(words, rows, p.window)
    ahead = np.maximum(np.arange(len(mark)) + p.run_marks, np.searchsorted(mark, mark + p.min_words))
    held = ahead < len(mark)
    first, last = mark[held], mark[ahead[held]]
    inside = rows[first] == rows[last]
    return first[inside], last[inside]


def unit_spans(column: pa.Array, p: UnitParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop, d1, d2) of the units of every text; bytes of that text, `stop` is where the next unit begins."""
    words, rows, start, end = word_hashes(column)
    raw, cut = text_bytes(column)
    n = len(words)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, empty
    line = np.cumsum(np.concatenate([[0], raw == 10]))[start]
    new_line = np.ones(n, dtype=bool)
    new_line[1:] = (rows[1:] != rows[:-1]) | (line[1:] != line[:-1])
    stops = np.isin(raw[end - 1], np.frombuffer(b".!?", dtype=np.uint8))
    new_sentence = new_line.copy()
    new_sentence[1:] |= stops[:-1]
    s = np.flatnonzero(new_sentence)
    length = np.diff(np.append(s, n))
    inside_long = np.repeat(length > p.long_sentence, length)
    new_part = new_sentence.copy()
    new_part[1:] |= inside_long[1:] & (words[:-1] % np.uint64(p.cut_one_in) == 0)
    found = [_runs(words, rows, p)]
    for mark in (new_line, new_sentence, new_part):
        first = np.flatnonzero(mark)
        last = np.append(first[1:], n)
        big = last - first >= p.min_words
        found.append((first[big], last[big]))
    first, last = (np.concatenate(x) for x in zip(*found))
    first, last = np.divmod(np.unique(first * (n + 1) + last), n + 1)
    d1, d2 = _digests(words, first, last)
    following = np.append(start, len(raw))[last]
    row = rows[first]
    stop = np.minimum(following, cut[row + 1])
    return row, start[first] - cut[row], stop - cut[row], d1.view(np.int64), d2.view(np.int64)


def _sent(ids: pa.Array, row: np.ndarray, start: np.ndarray, stop: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, place, d1, d2) to be ranked: of equal units in a batch only the earliest; of the others what is removed already, as
    merged spans with digests of their own. A place is start * 2**31 + stop, and -1 - place for a span that is removed already."""
    rank = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)[row]
    given = row, start, stop, d1, d2
    order = np.lexsort((start, rank, d2, d1))
    row, start, stop, d1, d2, rank = (x[order] for x in (row, start, stop, d1, d2, rank))
    new = np.ones(len(row), dtype=bool)
    new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = rank == rank[first]
    again = ~(same & (start == start[first]))
    # an occurrence that overlaps the first one leaves it whole
    lo = np.where(same, np.maximum(start, stop[first]), start)
    take = np.flatnonzero(again & (lo < stop))
    take = take[np.lexsort((lo[take], row[take]))]
    r, lo, hi = row[take], lo[take], stop[take]
    if len(r):
        far = np.int64(hi.max()) + 1
        reach = np.maximum.accumulate(hi + r * far)
        cut = np.ones(len(r), dtype=bool)
        cut[1:] = lo[1:] + r[1:] * far > reach[:-1]
        at = np.flatnonzero(cut)
        r, lo, hi = r[at], lo[at], np.maximum.reduceat(hi, at)
    own = mix((r.astype(np.uint64) << np.uint64(32)) + lo.astype(np.uint64) + d1[:1].view(np.uint64)).view(np.int64)
    keep = np.zeros(len(row), dtype=bool)
    keep[order] = ~again
    row, start, stop, d1, d2 = given
    place = np.concatenate([(start[keep] << 31) + stop[keep], ~((lo << 31) + hi)])
    return np.concatenate([row[keep], r]), place, np.concatenate([d1[keep], own]), np.concatenate([d2[keep], own])


def units(docs: DataFrame, p: UnitParameters) -> DataFrame:
    """(id, place, d1, d2) of the units of (id, text), see `_sent`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, 1):
                row, *values = _sent(batch.column(0), *unit_spans(batch.column(1), p))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), *(pa.array(x) for x in values)],
                    names=["id", "place", "d1", "d2"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"id {kind}, place long, d1 long, d2 long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def apart(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """What merged `spans` leave of [0, n)."""
    out, at = [], 0
    for a, b in spans:
        if a > at:
            out.append((at, a))
        at = b
    return [*out, (at, n)] if at < n else out


SPANS = "array<struct<start:bigint,stop:bigint>>"


def remove_repeats(
    docs: DataFrame, p: UnitParameters = UnitParameters(), id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`docs` with shortened `text`, `kept_spans` (bytes of the original text, in order) and `n_removed` (bytes).

    Occurrences are ranked by id and place. A null text stays null with no spans; an empty one stays empty. A null id is not ranked: its
    text is left whole. Rows that repeat an id count as one document: they keep and lose the same units. Columns of
    `docs` named like an output are replaced. Units are dealt by digest once; a very frequent one is sent once a batch, the other
    occurrences in the batch are known to go.
    """
    base = docs.drop("kept_spans", "n_removed")
    source = base.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    order = Window.partitionBy("d1", "d2").orderBy("id", "place").rowsBetween(Window.unboundedPreceding, 0)
    ranked = units(source, p).withColumn("first", F.first(F.struct("id", "place")).over(order))
    start, stop = (lambda c: F.shiftright(c, 31)), (lambda c: F.col(c).bitwiseAND(0x7FFFFFFF))
    sure, own = F.col("place") < 0, F.col("id") == F.col("first.id")
    other = ~own | (start("place") != start("first.place"))
    ranked = ranked.where(sure | other).withColumn("place", F.when(sure, F.bitwise_not("place")).otherwise(F.col("place")))
    # an occurrence that overlaps the first one leaves it whole
    clear = F.when(own & (F.col("first.place") >= 0), F.greatest(start("place"), stop("first.place"))).otherwise(start("place"))
    again = ranked.select("id", clear.alias("start"), stop("place").alias("stop")).where("start < stop")
    spans = again.groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))
    joined = base.join(spans.withColumnRenamed("id", id_column), id_column, "left")
    names = base.columns
    at_text, at_spans = joined.columns.index(text), joined.columns.index("__spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept, gone = [], [], []
            for value, spans in zip(batch.column(at_text), batch.column(at_spans)):
                raw = value.as_py()
                if raw is None or not spans.is_valid:
                    texts.append(raw)
                    size = len(raw.encode()) if raw else 0
                    kept.append([{"start": 0, "stop": size}] if size else [])
                    gone.append(0)
                    continue
                data = raw.encode()
                left = apart(merged([(s["start"], s["stop"]) for s in spans.as_py()]), len(data))
                texts.append(b"".join(data[a:b] for a, b in left).decode())
                kept.append([{"start": a, "stop": b} for a, b in left])
                gone.append(len(data) - sum(b - a for a, b in left))
            columns = [pa.array(texts, pa.string()) if n == text else batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(gone, pa.int64())],
                names=[*names, "kept_spans", "n_removed"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return joined.mapInArrow(cut, f"{fields}, kept_spans {SPANS}, n_removed bigint")
