"""Query of the web archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import warc
from corpusflow.llm.common import table
from corpusflow.llm.registry import query

# Five hexadecimal digits are four base32 digits.
SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p
)
SELECT page_id, size::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((list_reduce(list_transform(range(5), lambda j:
                    strpos('0123456789abcdef', substr(digest, (i // 4 * 5 + j + 1)::BIGINT, 1)) - 1),
                    lambda a, b: a * 16 + b) >> (15 - i % 4 * 5)::BIGINT) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


@query("op11_warc", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Writes every page and reads the files back."""
    return report(table(spark, folder, "pages"))


def report(pages: DataFrame, **options) -> DataFrame:
    records = warc.read(pages.sparkSession, warc.write(pages, **options))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
