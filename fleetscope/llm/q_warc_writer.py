"""op4: ``pages`` written as WARC files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetscope.llm.warc_writer import archive, read_archive

SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""


def op4_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archive(spark, root, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
