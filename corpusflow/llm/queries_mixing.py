"""Query of the mixing operator and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import table
from corpusflow.llm.mixing import mix
from corpusflow.llm.registry import query

SQL = r"""
WITH d AS (
    SELECT doc_id, source,
           CASE WHEN text IS NULL THEN 0
                ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source
), w AS (
    SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s
), v AS (
    SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
           2.0::DOUBLE * total AS cap
    FROM w
), l AS (
    SELECT *, cap / weight AS tight,
           ((SELECT sum(total) FROM v) * 1.5::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / ((SELECT sum(weight) FROM v)
              - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM v
), t AS (
    SELECT source, total,
           least(cap, coalesce(weight * (SELECT level FROM l WHERE level <= tight ORDER BY tight, place LIMIT 1), cap)) AS target
    FROM l
), p AS (
    SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::BIGINT AS passes FROM t
), g AS (
    SELECT p.source, p.target - p.passes * p.total AS rest, d.h, sum(d.size)::BIGINT AS here
    FROM p JOIN d ON d.source IS NOT DISTINCT FROM p.source GROUP BY ALL
), c AS (
    SELECT source, rest, h, sum(here) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto, here FROM g
), b AS (
    SELECT source, min(struct_pack(h := h, upto := upto, here := here, rest := rest)) AS f
    FROM c WHERE rest > 0 AND upto > rest GROUP BY source
), x AS (
    SELECT source, CASE WHEN (f.upto - f.rest) < (f.rest - (f.upto - f.here)) THEN f.h + 1 ELSE f.h END AS below FROM b
)
SELECT d.doc_id, d.size, p.total AS source_size, p.target,
       (d.size * (p.passes + CASE WHEN d.h < x.below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""


@query("op3_mixing", SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mix(docs).select(
        "doc_id",
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        F.col("__mix_taken").alias("taken"),
    )
