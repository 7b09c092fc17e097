"""Query of repeated passages and its SQL twin: every window as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm.common import table
from corpusflow.llm.registry import query
from corpusflow.llm.repeats import repeats

SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), w AS (
    SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS s
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), q AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM w) WHERE n > 1
), c AS (
    SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM q
), k AS (
    SELECT d.r, count(c.i) AS n_removed,
           string_agg(u.s, ' ' ORDER BY u.i) FILTER (c.i IS NULL) AS kept
    FROM d, LATERAL (SELECT unnest(d.ws) AS s, unnest(range(1, len(d.ws) + 1)) AS i) u
    LEFT JOIN c ON c.r = d.r AND c.i = u.i
    GROUP BY d.r
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""


@query("op9_repeats", SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return repeats(docs).drop("spans")
