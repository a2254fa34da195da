"""WARC archives: a Python data source that reads them, and a writer.

Reading. Files are planned into partitions by size. The source takes equality, membership and prefix predicates on the
record's own columns: a record's headers are inflated first, and a record that fails a predicate, or whose payload is not wanted
(`payload` option `false`), is left there. If its gzip member tells its length (extra field `sl`) the reader jumps to the
next one; otherwise the rest is inflated in pieces and dropped. A member may hold several records; they share its offset. A file
that breaks the format (no headers within `MOST_HEADERS` bytes, a length that is no number, an early end) is refused by name. Paths are opened through pyarrow's file systems, so local,
HDFS and object-store URIs work alike from every executor.

Writing. One task writes one or more files of whole records, one gzip member for each record. A task that runs again writes
files of another name; only the files in the returned manifest count.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from traceframe.llm.common import shared_folder, stored

SCHEMA = (
    "file string, offset long, record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, content_length long, payload_length long, headers map<string,string>, "
    "http_headers map<string,string>, payload binary"
)
# Names of the format.
VERSION = b"WARC/1.1"
COLUMN_OF = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
GZIP_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"  # magic, deflate, extra field, no time, unknown system
CHUNK = 1 << 16
MOST_HEADERS = 16 << 20


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    if uri.startswith("file:"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that tells its own compressed and plain length in the extra field `sl`."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"sl" + struct.pack("<HQQ", 16, len(GZIP_HEAD) + 2 + 20 + len(body) + 8, len(data))
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return GZIP_HEAD + struct.pack("<H", len(extra)) + extra + body + tail


def record(headers: dict[str, str], http: dict[str, str], payload: bytes | None, status: str = "HTTP/1.1 200 OK") -> bytes:
    """One record; without a payload (a revisit) the block has the HTTP headers only."""
    clean = lambda v: v.replace("\r", " ").replace("\n", " ")
    block = (status + "\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in http.items()) + "\r\n").encode() + (payload or b"")
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items())
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class _Source:
    """Bytes of the records of one file, plain or gzip; knows how to leave a record early."""

    def __init__(self, stream) -> None:
        self.stream = stream
        self.held = b""
        self.at = 0
        self.zip = self.start = self.jump = None
        self.plain = b""
        self.left = 0  # plain bytes of the member that are not used yet, where it tells its length

    def _raw(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        if len(out) < n:
            out += self.stream.read(n - len(out))
        return out

    def open_record(self) -> bool:
        """Stand at the next record, in the same gzip member if it goes on; False at the end of the file."""
        while self.zip is not None:
            while self.plain.startswith(b"\r\n"):
                self._use(2)
            if len(self.plain) >= 2:
                return True
            if not self.more():
                if self.plain:
                    raise EOFError("a record ends early")
                break
        while True:
            self.start = self.stream.tell() - len(self.held)
            two = self._raw(2)
            if two != b"\r\n":
                break
        self.zip, self.jump, self.plain = None, None, b""
        if not two:
            return False
        self.held = two + self.held
        if two == b"\x1f\x8b":
            self.zip = zlib.decompressobj(31)
            head = self._raw(12)
            if len(head) == 12 and head[3] & 4:
                extra = self._raw(struct.unpack("<H", head[10:])[0])
                self.held = extra + self.held
                if extra[:2] == b"sl" and len(extra) >= 20:
                    size, self.left = struct.unpack("<QQ", extra[4:20])
                    self.jump = self.start + size
            self.held = head + self.held
        return True

    def _use(self, n: int) -> bytes:
        out, self.plain = self.plain[:n], self.plain[n:]
        self.left -= len(out)
        return out

    def more(self) -> bool:
        """Add to `plain`; False when the member or the file ends."""
        if self.zip is None:
            new = self._raw(CHUNK)
            self.plain += new
            return bool(new)
        if self.zip.eof:
            return False
        new = self.zip.unconsumed_tail or self._raw(CHUNK)
        if not new:
            raise EOFError("a gzip member ends early")
        self.plain += self.zip.decompress(new, CHUNK)
        if self.zip.eof:
            self.held = self.zip.unused_data + self.held
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (at := self.plain.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.plain)
            if at > MOST_HEADERS:
                raise ValueError("headers do not end")
            if not self.more():
                raise EOFError("headers end early")
        return self._use(at + len(mark))[:at]

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if not self.plain and not self.more():
                raise EOFError("a block ends early")
            parts.append(self._use(n - have))
            have += len(parts[-1])
        return b"".join(parts)

    def leave(self, left: int) -> None:
        """Go past the rest of the record, `left` bytes of its block included."""
        if self.zip is None:
            here = self.stream.tell() - len(self.held) - len(self.plain)
            self.stream.seek(here + left)
            self.held = self.plain = b""
        elif self.jump is not None and self.left - left <= 4:  # only the blank lines after the record are left
            self.stream.seek(self.jump)
            self.held = self.plain = b""
            self.zip = None
        else:
            while left:
                if not self.plain and not self.more():
                    raise EOFError("a block ends early")
                left -= len(self._use(left))


def _fields(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:  # a folded line goes on with the one before
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            out[last] = value.strip()
    return out


@dataclass
class Predicates:
    """The predicates taken from the plan; all must hold. Values of one column are a set or a prefix."""

    among: list[tuple[str, frozenset]] = field(default_factory=list)
    prefixes: list[tuple[str, str]] = field(default_factory=list)
    present: list[str] = field(default_factory=list)

    def accept(self, f) -> bool:
        name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
        if name not in COLUMN_OF:
            return False
        if isinstance(f, EqualTo):
            self.among.append((name, frozenset([f.value])))
        elif isinstance(f, In):
            self.among.append((name, frozenset(f.value)))
        elif isinstance(f, StringStartsWith):
            self.prefixes.append((name, f.value))
        elif isinstance(f, IsNotNull):
            self.present.append(name)
        else:
            return False
        return True

    def hold(self, columns: dict[str, str | None]) -> bool:
        value = columns.get
        return (
            all(value(c) is not None and value(c) in vs for c, vs in self.among)
            and all((value(c) or "").startswith(p) and value(c) is not None for c, p in self.prefixes)
            and all(value(c) is not None for c in self.present)
        )


def read_records(stream, name: str, tests: Predicates, payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA for the records of an open file that pass `tests`; a broken file is refused with its name and the place."""
    source = _Source(stream)
    try:
        yield from _records(source, name, tests, payload)
    except (EOFError, ValueError, zlib.error) as problem:
        raise ValueError(f"{name}, record at byte {source.start}: {problem}") from problem


def _records(source: _Source, name: str, tests: Predicates, payload: bool) -> Iterator[tuple]:
    while source.open_record():
        start = source.start
        lines = source.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record")
        head = _fields(lines[1:])
        told = head.get("content-length", "0")
        if not (told.isascii() and told.isdigit()):
            raise ValueError(f"Content-Length {told[:40]!r} is no number")
        length = int(told)
        columns = {c: head.get(h) for c, h in COLUMN_OF.items()}
        if not tests.hold(columns):
            source.leave(length)
            continue
        kind = head.get("content-type", "")
        http: dict[str, str] = {}
        left = length
        if kind.startswith("application/http") and length:
            raw = source.until(b"\r\n\r\n")
            left -= len(raw) + 4
            http = _fields(raw.decode("utf-8", "replace").split("\r\n")[1:])
        body = None
        if payload and columns["record_type"] != "revisit":
            body = source.take(left)
            left = 0
        told = http.get("content-length", "")
        source.leave(left)
        yield (
            name, start, *(columns[c] for c in ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest")),
            length, int(told) if told.isdigit() else None, head, http, body,
        )


@dataclass
class FileSet(InputPartition):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = [f for f in options.get("files", "").split("\n") if f]
        self.path = options.get("path")
        self.payload = options.get("payload", "true").lower() == "true"
        self.target = int(options.get("partitionbytes", 64 << 20))
        self.tests = Predicates()

    def pushFilters(self, filters):
        for f in filters:
            if not self.tests.accept(f):
                yield f

    def partitions(self) -> list[FileSet]:
        """Whole files, filled up to about `partitionBytes`; a larger file stands alone."""
        found: list[tuple[str, int]] = []
        if self.files:
            for uri in self.files:
                system, path = located(uri)
                found.append((uri, system.get_file_info(path).size))
        else:
            system, path = located(self.path)
            base = self.path.removesuffix(path) if self.path.endswith(path) else "file://"
            infos = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
            found = [(base + i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        sets: list[FileSet] = []
        room = 0
        for uri, size in sorted(found):
            if not sets or room < size:
                sets.append(FileSet([]))
                room = self.target
            sets[-1].files.append(uri)
            room -= size
        return sets or [FileSet([])]

    def read(self, partition: FileSet) -> Iterator[tuple]:
        for uri in partition.files:
            system, path = located(uri)
            with system.open_input_file(path) as stream:
                yield from read_records(stream, uri, self.tests, self.payload)


class WarcSource(DataSource):
    """`spark.read.format("warc")` with `path` (file or folder) or `files` (lines), `payload` (true), `partitionBytes`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, files: list[str] | None = None, path: str | None = None, payload: bool = True) -> DataFrame:
    """Records of archives as rows. Sets `spark.sql.python.filterPushdown.enabled`: Spark refuses such a source without it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("payload", str(payload).lower())
    return reader.option("files", "\n".join(files)).load() if files is not None else reader.load(path)


def with_revisits(pages: DataFrame, least: int = 100, id_column: str = "page_id", body: str = "html") -> DataFrame:
    """`pages` with `payload_digest`, `payload_bytes`, `record_type`, `refers_to`.

    Of equal payloads of at least `least` bytes the row with the smallest id is the response and the others, further rows of the
    same id included only if their id is larger, revisit it. Null payloads are empty. A null id never is the one referred to.
    """
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    told = pages.drop("payload_digest", "payload_bytes", "record_type", "refers_to")
    told = told.withColumn("payload_digest", F.sha2(payload, 256)).withColumn("payload_bytes", F.octet_length(payload).cast("bigint"))
    first = (
        told.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min(id_column).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .drop("__n")
    )
    joined = told.join(first, "payload_digest", "left")
    again = F.col("__first").isNotNull() & ~F.col(id_column).eqNullSafe(F.col("__first"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(again, F.col("__first"))
    ).drop("__first")


def write_warc(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", roll: int = 256 << 20) -> DataFrame:
    """Write rows (`record_id`, `uri`, `record_type`, `refers_to`, `payload_digest`, `payload_bytes`, `payload`) and return the manifest.

    The manifest (`file`, `records`, `bytes`) is stored. `folder` must be one that all executors share.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = located(folder)
        system.create_dir(base, recursive=True)
        stem = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}"
        done: list[tuple[str, int, int]] = []
        stream, n, size = None, 0, 0
        for batch in batches:
            for row in (r for lo in range(0, batch.num_rows, 64) for r in batch.slice(lo, 64).to_pylist()):
                if stream is None:
                    name = f"{stem}-{len(done):04d}.warc.gz"
                    stream, n, size = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                headers = {
                    "WARC-Type": row["record_type"],
                    "WARC-Record-ID": row["record_id"],
                    "WARC-Date": date,
                    "WARC-Target-URI": row["uri"] or "",
                    "WARC-Payload-Digest": "sha256:" + row["payload_digest"],
                    "Content-Type": "application/http; msgtype=response",
                }
                revisit = row["record_type"] == "revisit"
                if revisit:
                    headers["WARC-Refers-To"] = row["refers_to"]
                    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                http = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(row["payload_bytes"])}
                member = gzip_member(record(headers, http, None if revisit else row["payload"]))
                stream.write(member)
                n, size = n + 1, size + len(member)
                if size >= roll:
                    stream.close()
                    done.append((f"{folder}/{name}", n, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((f"{folder}/{name}", n, size))
        if done:
            file, count, length = map(list, zip(*done))
            yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(count, pa.int64()), pa.array(length, pa.int64())], names=["file", "records", "bytes"])

    columns = ("record_id", "uri", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
    return stored(records.select(*columns).mapInArrow(write, "file string, records long, bytes long"))


def archive_pages(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Write `pages` as archives and read them back: the rows of SCHEMA, as they come from the files.

    The driver holds the names of the files, one for each writing task and 256 MB.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    told = with_revisits(pages.select(id_column, url, body), id_column=id_column, body=body)
    records = told.select(
        name(id_column).alias("record_id"), F.col(url).alias("uri"), "record_type", F.when(F.col("refers_to").isNotNull(), name("refers_to")).alias("refers_to"),
        "payload_digest", "payload_bytes", F.when(F.col("record_type") == "response", F.coalesce(F.col(body), F.lit("")).cast("binary")).alias("payload"),
    )
    manifest = write_warc(records, folder)
    files = [r["file"] for r in manifest.select("file").collect()]
    return read_warc(spark, files=files) if files else spark.createDataFrame([], SCHEMA)
