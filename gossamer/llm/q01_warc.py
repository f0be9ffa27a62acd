"""Query 1: pages to WARC archives and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import warc

QUERY = "op1_warc_chunks"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write one WARC record per page, read the archives back and return what they say of each page.

    The payload digest and length of a response are those of the bytes read; a
    revisit has no bytes, so its own headers give them. Rows that repeat a page
    give one record each; a null page_id is kept.
    """
    index = warc.write_archives(warc.roles(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    files = index.select("archive").distinct()
    # A task an archive; a fixed number, which adaptive execution doesn't merge though the rows are few.
    chunks = warc.read_chunks(files.repartition(max(1, files.count())), with_bytes=False).filter("last")
    said = F.from_json("headers", "map<string,string>")
    head = lambda name: F.try_element_at("said", F.lit(name))
    revisit = F.col("record_type") == "revisit"
    return (
        chunks.withColumn("said", said)
        .withColumn("record_type", head("warc-type"))
        .select(
            F.nullif(head("x-record-key"), F.lit("")).cast("long").alias("page_id"),
            F.when(revisit, head("x-payload-length").cast("long")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
            F.when(revisit, F.substring_index(head("warc-payload-digest"), ":", -1)).otherwise(F.col("digest_so_far")).alias("payload_digest"),
            "record_type",
            F.when(revisit, F.regexp_extract(head("warc-refers-to"), r"page:(-?\d+)", 1).cast("long")).alias("refers_to"),
        )
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM p),
g AS (SELECT page_id, payload_bytes, hex, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top_id FROM d),
b AS (SELECT *, list_transform(range(8), lambda j: ('0x' || substr(hex, 5 * j + 1, 5))::BIGINT) AS parts FROM g)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(parts, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM top_id AND top_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top_id THEN top_id END AS refers_to
FROM b
"""
