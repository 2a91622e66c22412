"""Queries on web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreline.llm.registry import query, table
from boreline.llm.shared import new_path
from boreline.llm.warc_store import read_records, write_archive

SQL_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
newest AS (SELECT h, max(page_id) AS newest FROM p WHERE strlen(h) >= 1000 GROUP BY h),
j AS (SELECT p.page_id, p.h, CASE WHEN p.page_id IS DISTINCT FROM newest THEN newest END AS refers_to
      FROM p LEFT JOIN newest USING (h))
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM j"""


@query("op1_warc", SQL_WARC)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archive all pages, read the records back and describe them."""
    path = new_path(spark, "warc")
    write_archive(table(spark, folder, "pages"), path)
    return read_records(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                                            F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
