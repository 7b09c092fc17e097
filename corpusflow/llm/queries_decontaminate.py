"""Query of benchmark decontamination; no SQL twin, tests compare with a brute-force edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import decontaminate
from corpusflow.llm.common import table
from corpusflow.llm.registry import query


@query("op6_decontaminate")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item it holds; clean documents have none."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, folder, "benchmark"))
