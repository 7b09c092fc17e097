"""Query of near-duplicate detection and its SQL twin: exact sets, exact links, smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm.common import table
from corpusflow.llm.near_dedup import near_duplicates
from corpusflow.llm.registry import query

# Pairs come from an exact prefix filter: of two sets with a Jaccard similarity of 0.8, the
# rarest (n - ceil(0.8 n) + 1) members of either hold a common one.
SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT doc_id, unnest(list_distinct(
        CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
             ELSE [ws[i] || chr(10) || ws[i + 1] FOR i IN range(1, len(ws))] END)) AS g
    FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), q AS (
    SELECT g, count(*) AS q FROM s GROUP BY g
), f AS (
    SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY q.q, s.g) AS r
    FROM s JOIN n USING (doc_id) JOIN q USING (g)
), p AS (
    SELECT doc_id, g, n FROM f WHERE r <= n - ceil(0.8 * n) + 1
), c AS (
    SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny
    FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id
    WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), l AS (
    SELECT x, y FROM c JOIN s a ON a.doc_id = c.x JOIN s b ON b.doc_id = c.y AND a.g = b.g
    GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 80 * (nx + ny - count(*))
), e AS (
    SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, e.y FROM reach JOIN e ON e.x = reach.b
), m AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
"""


@query("op1_near_dedup", SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs, words=2, percent=80).drop("text_hash")
