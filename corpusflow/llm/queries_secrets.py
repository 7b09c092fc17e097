"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import secrets
from corpusflow.llm.common import shared_folder, table
from corpusflow.llm.registry import query


def _sql() -> str:
    """The same matches by DuckDB's own expressions."""
    parts = []
    for no, rule in enumerate(secrets.RULES, 1):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
    SELECT rowid, {no} AS no, '{rule.kind}' AS kind,
           unnest(regexp_extract_all(t, '{pattern}')) AS m,
           unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS judged,
           unnest(string_split_regex(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}'))]) AS gap,
           unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i, {rule.least} AS least, '{rule.lead}' AS lead
    FROM d WHERE regexp_matches(t, '{pattern}')""")
    base = len(secrets.BASE)
    return f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rowid FROM documents
), m AS ({" UNION ALL ".join(parts)}
), p AS (
    SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rowid, no ORDER BY i) AS stop FROM m
), f AS (
    SELECT rowid, no, kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS s, stop - length(m) AS start
    FROM p WHERE length(judged) >= least AND starts_with(m, lead)
), a AS (
    SELECT rowid, count(*) FILTER (no = 1) AS n_assign, count(*) FILTER (no = 2) AS n_access,
           count(*) FILTER (no = 3) AS n_hex,
           string_agg(s, ',' ORDER BY start, no) FILTER (no <= {base}) AS base,
           string_agg(s, ',' ORDER BY start, no) AS spans
    FROM f GROUP BY rowid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rowid)
"""


@query("op10_secrets", _sql())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Starts from an empty ledger, so every distinct text is scanned by every rule."""
    return report(table(spark, folder, "documents"), shared_folder(spark, "secret-ledger"))


def report(docs: DataFrame, ledger: str) -> DataFrame:
    secrets.scan(docs, ledger)
    found = secrets.findings(docs, ledger)

    def count(no: int):
        return F.size(F.filter("spans", lambda s: s["no"] == no)).cast("bigint")

    base = F.filter("spans", lambda s: s["no"] <= len(secrets.BASE))
    return found.select(
        "doc_id",
        *[count(no).alias(f"n_{rule.kind}") for no, rule in enumerate(secrets.BASE, 1)],
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )
