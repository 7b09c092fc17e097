"""Query of the conversation trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import prefix_trie
from corpusflow.llm.common import table
from corpusflow.llm.queries_variants import CRC_TABLE, crc32
from corpusflow.llm.registry import query

SQL = f"""
WITH {CRC_TABLE}, r AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS pos
    FROM (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words,
                 sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS said
          FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM r), crc
), s AS (
    SELECT c.conv_id, 0 AS part, pos, words, said FROM c JOIN r ON r.conv_id = c.base AND pos <= h
    UNION ALL SELECT c.conv_id, 1, pos, words, said FROM c JOIN r ON r.conv_id = c.conv_id AND pos > h
), d AS (
    SELECT conv_id, words, said, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM s
), m AS (
    SELECT conv_id, depth, words, sha256(string_agg(said, '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM d
    UNION ALL SELECT conv_id, 0, 0, '' FROM c
), l AS (
    SELECT *, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) AS next FROM m
), n AS (
    SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(words) AS words, count(*) AS n_convs,
           count(DISTINCT next) AS n_children,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (next IS NULL), '')) AS ends_sha256
    FROM l GROUP BY node
), below AS (
    SELECT DISTINCT a.node AS top, b.node FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), sums AS (
    SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
    FROM below JOIN n ON n.node = below.node GROUP BY top
), up AS (
    SELECT DISTINCT next AS node, node AS parent FROM l WHERE next IS NOT NULL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN sums USING (node) LEFT JOIN up USING (node) LEFT JOIN n p ON p.node = up.parent
"""


@query("op13_prefix_trie", SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))
