"""Archives: round trip, predicates, other writers' files."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from traceframe.llm.warc import Predicates, archive_pages, gzip_member, read_records, read_warc, record


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "x" * 200
    rows = [(1, "http://a/1", long), (2, None, long), (3, "http://a/3\r\nX: y", None), (4, "http://a/4", ""), (5, "u", "small"), (6, "u", "small"),
            (7, "u", long), (8, "http://b", "é" * 120), (None, "u", "z" * 150), (None, "u", "z" * 150)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))


def test_round_trip(pages):
    got = {r["record_id"]: r for r in archive_pages(pages).collect()}
    assert len(got) == 9  # the two rows without id share a name
    one = got["<urn:x-page:1>"]
    assert one["record_type"] == "response" and bytes(one["payload"]) == ("<p>" + "x" * 200).encode()
    for i in (2, 7):
        r = got[f"<urn:x-page:{i}>"]
        assert (r["record_type"], r["refers_to"], r["payload"], r["payload_length"]) == ("revisit", "<urn:x-page:1>", None, 203)
        assert r["payload_digest"] == one["payload_digest"] == "sha256:" + hashlib.sha256(bytes(one["payload"])).hexdigest()
    assert {got[f"<urn:x-page:{i}>"]["record_type"] for i in (3, 4, 5, 6, 8)} == {"response"}
    assert bytes(got["<urn:x-page:3>"]["payload"]) == b"" and bytes(got["<urn:x-page:8>"]["payload"]) == ("é" * 120).encode()


def test_predicates_reach_the_source(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    archive_pages(pages, folder).count()
    back = read_warc(spark, path=folder, payload=False).where((F.col("record_type") == "revisit") & F.col("record_id").startswith("<urn:x-page:"))
    assert {r["record_id"] for r in back.collect()} == {"<urn:x-page:2>", "<urn:x-page:7>"}
    assert back.where("payload is not null").count() == 0


def test_empty_table(pages):
    assert archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("packed", ["plain", "members", "one member", "one member with lengths"])
def test_files_of_other_writers(packed):
    records = [record({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>", "Content-Type": "application/http"}, {"Content-Length": "70000"}, b"p%d" % i * 35000) for i in range(3)]
    records.insert(1, record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<info>", "Content-Type": "text/plain"}, {}, b"note"))
    if packed == "one member":
        data = gzip.compress(b"".join(records))
    elif packed == "one member with lengths":
        data = gzip_member(b"".join(records[:3])) + gzip_member(records[3])
    else:
        data = b"".join(gzip.compress(r) if packed == "members" else r for r in records)
    tests = Predicates(among=[("record_type", frozenset(["response"]))])
    rows = list(read_records(io.BytesIO(data), "f", tests, True))
    assert [r[2] for r in rows] == ["<0>", "<1>", "<2>"]
    assert all(len(r[-1]) == 70000 for r in rows)
    assert [r[-1] for r in read_records(io.BytesIO(data), "f", tests, False)] == [None] * 3


@pytest.mark.parametrize("data", [b"no record at all\r\n\r\n", b"WARC/1.1\r\nContent-Length: many\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"), gzip.compress(b"WARC/1.1\r\n" * 99)[:40], b"WARC/1.1\r\nx: y"])
def test_broken_files_are_refused_by_name(data):
    with pytest.raises(ValueError, match="f.warc, record at byte 0"):
        list(read_records(io.BytesIO(data), "f.warc", Predicates(), True))


def test_a_very_long_payload(spark):
    long = "é" * 3_000_000
    back = archive_pages(spark.createDataFrame([(1, "u", long), (2, "u", long)], "page_id long, url string, html string")).collect()
    assert sorted((r["record_type"], r["payload"] and len(r["payload"])) for r in back) == [("response", 6_000_000), ("revisit", None)]
