"""JSON documents {"rows": [...], ...} of any length, read by byte ranges.

A range cannot tell by itself whether it begins inside a string or how deep it lies, so the ranges are read three times:

1. Each range sums itself up for both cases (begins outside or inside a string): flips of the string state and net depth.
   Running totals over the ranges of a document give the true state at each beginning.
2. With that state a range gives the document's *skeleton* (its text with nested values emptied), which brackets at depth
   one it opens, and its separators; running totals give the number of the first row in each range.
3. A range gives the rows that begin in it and reads on past its end to finish the last.

Ranges end where no backslash stands before, so an escape never crosses an end. Only standard JSON in UTF-8 is understood, and the
list's key has to be written without escapes. A task holds one range and one row; the text beside the rows is held per document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from traceframe.session import checkpointed

SPLIT = 8 << 20
_BATCH = 4 << 20
RANGE = "path STRING, start LONG, stop LONG, length LONG"


def opened(uri: str):
    """A file that can be read from any place, by a path as Spark names it (not percent-encoded)."""
    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    system, path = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return system.open_input_file(path)


def _cut(stream, at: int, length: int) -> int:
    """First place from `at` on without a backslash before it."""
    if at <= 0 or at >= length:
        return min(max(at, 0), length)
    stream.seek(at - 1)
    while piece := stream.read(4096):
        other = np.flatnonzero(np.frombuffer(piece, dtype=np.uint8) != 92)
        if len(other):
            return min(at + int(other[0]), length)
        at += len(piece)
    return length


def _bytes_of(stream, lo: int, hi: int) -> np.ndarray:
    stream.seek(lo)
    return np.frombuffer(stream.read(hi - lo), dtype=np.uint8)


def _flips(raw: np.ndarray) -> np.ndarray:
    """For each byte whether an odd number of string quotes stands up to and with it."""
    quote = raw == 34
    slash = np.flatnonzero(raw == 92)
    if len(slash):
        first = np.append(True, np.diff(slash) > 1)
        run = np.maximum.accumulate(np.where(first, slash, 0))
        escaped = slash[(slash - run) % 2 == 0] + 1
        quote[escaped[escaped < len(raw)]] = False
    return np.bitwise_xor.accumulate(quote) if len(raw) else quote


def _steps(raw: np.ndarray) -> np.ndarray:
    """1 at an opening bracket of either kind, -1 at a closing one."""
    folded = raw | 32  # '[' and '{', ']' and '}' differ in this bit only
    return (folded == 123).astype(np.int8) - (folded == 125).astype(np.int8)


@dataclass
class Walk:
    """Depth after each byte of a piece of text, and which bytes stand outside strings."""

    raw: np.ndarray
    outside: np.ndarray
    step: np.ndarray
    depth: np.ndarray

    @staticmethod
    def of(raw: np.ndarray, inside: bool, depth: int) -> Walk:
        outside = _flips(raw) == inside
        step = np.where(outside, _steps(raw), 0).astype(np.int8)
        return Walk(raw, outside, step, np.cumsum(step, dtype=np.int32) + np.int32(depth))

    def opens(self) -> np.ndarray:
        return np.flatnonzero((self.step == 1) & (self.depth == 2))

    def closes(self) -> np.ndarray:
        return np.flatnonzero((self.step == -1) & (self.depth == 1))

    def commas(self) -> np.ndarray:
        return np.flatnonzero(self.outside & (self.depth == 2) & (self.raw == 44))


def _under_key(stream, at: int, key: str) -> bool:
    """Whether the bracket at `at` is a list under `key`; looks back as far as blanks and key reach."""
    stream.seek(at)
    if stream.read(1) != b"[":
        return False
    want = re.compile(rb'(?<!\\)' + re.escape(json.dumps(key, ensure_ascii=False).encode()) + rb"[ \t\r\n]*:[ \t\r\n]*\Z")
    back = 256
    while True:
        lo = max(0, at - back)
        stream.seek(lo)
        text = stream.read(at - lo)
        bare = text.rstrip(b" \t\r\n").removesuffix(b":").rstrip(b" \t\r\n")
        if lo == 0 or len(bare) > len(key.encode()) * 6 + 3:
            return want.search(text) is not None
        back *= 2


def _mapped(ranges: DataFrame, columns: str, fn, schema: str, tasks: int) -> DataFrame:
    """`fn(stream, lo, hi, row)` on the true ends of every range; it yields tuples of `schema`."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"LONG": pa.int64(), "STRING": pa.string(), "BOOLEAN": pa.bool_(), "BINARY": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as stream:
                    lo, hi = (_cut(stream, row[c], row["length"]) for c in ("start", "stop"))
                    for out in fn(stream, lo, hi, row):
                        held.append(out)
                        size += 64 + sum(len(v) for v in out if isinstance(v, (str, bytes)))
                        if size > _BATCH:
                            yield pack(held)
                            held, size = [], 0
        if held:
            yield pack(held)

    return ranges.select(*columns.split(", ")).repartition(tasks, "path", "start").mapInArrow(run, schema)


def _summaries(stream, lo: int, hi: int, row: dict) -> Iterator[tuple]:
    raw = _bytes_of(stream, lo, hi)
    flips, step = _flips(raw), _steps(raw)
    total, odd = int(step.sum(dtype=np.int64)), int(step[flips].sum(dtype=np.int64))
    yield (*(row[c] for c in ("path", "start", "stop", "length")), int(flips[-1]) if len(raw) else 0, total - odd, odd)


def json_rows(
    spark: SparkSession, path: str, rows_at: str, row_ddl: str, split: int = SPLIT
) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, warnings) of the JSON documents at `path`, as `json_objects` gives them, read in ranges of `split` bytes.

    Rows have path, frame, label, place and row. A missing path or an empty file gives no rows. A document that is no object, has no list or
    more than one under `rows_at`, does not end, or holds a value that is no JSON gives a warning and no rows; values that
    are not objects are skipped but keep their place.
    """
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "length")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        files = spark.createDataFrame([], "path STRING, length LONG")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("bigint")))
    cut = files.select("path", starts.alias("start"), "length")
    ranges = checkpointed(cut.select("path", "start", F.least(F.col("start") + split, "length").alias("stop"), "length"))
    tasks = max(1, min(ranges.count(), 4 * spark.sparkContext.defaultParallelism))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(c) -> F.Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    sums = _mapped(ranges, "path, start, stop, length", _summaries, RANGE + ", flips LONG, outer LONG, inner LONG", tasks)
    told = sums.withColumn("inside", F.pmod(earlier("flips"), F.lit(2)) == 1)
    told = told.withColumn("net", F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer")))
    told = checkpointed(told.select("path", "start", "stop", "length", "inside", earlier("net").alias("depth")))

    def structure(stream, lo: int, hi: int, row: dict) -> Iterator[tuple]:
        walk = Walk.of(_bytes_of(stream, lo, hi), row["inside"], row["depth"])
        opens, commas = walk.opens(), walk.commas()
        ours = np.array([_under_key(stream, lo + int(at), rows_at) for at in opens], dtype=bool)
        owner = np.searchsorted(opens, commas)  # 0: a list opened in an earlier range
        own = int(ours.sum() + ours[owner[owner > 0] - 1].sum())
        bare = walk.raw[(walk.depth <= 1) | ((walk.step == 1) & (walk.depth == 2))].tobytes()
        last = bool(ours[-1]) if len(opens) else None
        yield (*(row[c] for c in ("path", "start", "stop", "length", "inside", "depth")), bare, last, int((owner == 0).sum()), own, int(ours.sum()))

    state = RANGE + ", inside BOOLEAN, depth LONG"
    parts = _mapped(told, "path, start, stop, length, inside, depth", structure, state + ", bare BINARY, opened BOOLEAN, head LONG, own LONG, lists LONG", tasks)
    parts = checkpointed(parts)
    inner = (F.col("depth") >= 2) & F.coalesce(F.last("opened", ignorenulls=True).over(before), F.lit(False))
    placed = parts.drop("bare").withColumn("listed", inner)
    placed = placed.withColumn("place", earlier(F.when(F.col("listed"), F.col("head")).otherwise(0) + F.col("own")))

    ordered = F.array_sort(F.collect_list(F.struct("start", "bare")))
    docs = parts.groupBy("path").agg(
        F.decode(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["bare"])), "UTF-8").alias("value"), F.sum("lists").alias("lists")
    )
    head = F.from_json("value", f"`{rows_at}` ARRAY<STRING>, frame STRING, label STRING, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    is_object = F.col("value").rlike(r"^\s*\{")
    docs = docs.select("path", "lists", F.when(is_object, head).alias("h"))
    sound = F.col("h").isNotNull() & F.col("h._bad").isNull() & F.col(f"h.{rows_at}").isNotNull() & (F.col("lists") == 1)
    docs = docs.select("path", "h.frame", "h.label", F.coalesce(sound, F.lit(False)).alias("sound"))

    def elements(stream, lo: int, hi: int, row: dict) -> Iterator[tuple]:
        walk = Walk.of(_bytes_of(stream, lo, hi), row["inside"], row["depth"])
        opens = walk.opens()
        ours = np.array([row["listed"], *(_under_key(stream, lo + int(at), rows_at) for at in opens)], dtype=bool)
        marks = np.sort(np.concatenate([opens, walk.commas(), walk.closes()]))
        marks = marks[ours[np.searchsorted(opens, marks, side="right")]]
        data = walk.raw.tobytes()
        place = row["place"]
        for a, b in zip(marks, [*marks[1:], None]):
            if data[a] in b"]}":
                continue
            raw = data[a + 1 : b]
            if b is None:
                raw += _rest(stream, hi, bool(walk.outside[-1]), int(walk.depth[-1]))
            empty = data[a] == 91 and not raw.strip(b" \t\r\n") and _closes(stream, lo + int(a) + 1 + len(raw))
            if not empty:
                try:
                    json.loads(raw)
                    yield row["path"], place, raw.strip(b" \t\r\n").decode(), True
                except ValueError:
                    yield row["path"], place, None, False
            place += 1

    columns = "path, start, stop, length, inside, depth, listed, place"
    found = checkpointed(_mapped(placed, columns, elements, "path STRING, place LONG, raw STRING, good BOOLEAN", tasks))
    broken = found.where(~F.col("good")).select("path").distinct().withColumn("broken", F.lit(True))
    docs = docs.join(broken, "path", "left").withColumn("sound", F.col("sound") & F.col("broken").isNull()).drop("broken")
    docs = checkpointed(docs)
    warnings = docs.where(~F.col("sound")).select("path", F.lit("not readable as an object with a list").alias("warning"))
    rows = found.where(F.col("raw").startswith("{")).join(docs.where("sound").drop("sound"), "path")
    row = F.from_json("raw", StructType.fromDDL(row_ddl)).alias("row")
    return rows.select("path", "frame", "label", F.col("place").cast("int").alias("place"), row), warnings


def write_json_rows(rows: DataFrame, folder: str, rows_at: str = "rows", frame: str | None = None) -> None:
    """Write each row of `rows` as an object of the list in a document; one document a partition, streamed, with Spark's committer."""
    opening = json.dumps({"frame": frame})[:-1] + ", " if frame is not None else "{"

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        line = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield line([opening + json.dumps(rows_at) + ": ["] if first else [])
                yield line([("" if first and not i else ", ") + t for i, t in enumerate(texts)])
                first = False
        if not first:
            yield line(["]}"])

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(wrap, "value STRING").write.text(folder)


def _rest(stream, at: int, outside: bool, depth: int) -> bytes:
    """The bytes from `at` up to the separator or bracket that ends a value of a list at depth two; all if none comes."""
    parts = []
    size = 4096
    stream.seek(0, 2)
    length = stream.tell()
    while at < length:
        stop = _cut(stream, min(at + size, length), length)
        walk = Walk.of(_bytes_of(stream, at, stop), not outside, depth)
        ends = np.sort(np.concatenate([walk.commas(), walk.closes()]))
        if len(ends):
            return b"".join([*parts, walk.raw[: ends[0]].tobytes()])
        parts.append(walk.raw.tobytes())
        outside, depth, at = bool(walk.outside[-1]), int(walk.depth[-1]), stop
        size = min(size * 2, SPLIT)
    return b"".join(parts)


def _closes(stream, at: int) -> bool:
    stream.seek(at)
    return stream.read(1) == b"]"
