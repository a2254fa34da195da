"""Query of the WARC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.registry import query, table
from traceframe.llm.warc import archive_pages

WARC_SQL = """
WITH told AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
first AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f FROM told)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to
FROM first
"""


@query("op2_warc", WARC_SQL)
def op2_warc(spark: SparkSession, directory: str) -> DataFrame:
    """Digest and length of a response are those of the payload read back; a revisit has them in its headers."""
    back = archive_pages(table(spark, directory, "pages"))
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("bigint")
    return back.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("bigint"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
