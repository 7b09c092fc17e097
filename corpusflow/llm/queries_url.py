"""Query of the URL filter; no SQL twin for the trained part, tests check rules by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import url_filter
from corpusflow.llm.common import table
from corpusflow.llm.registry import query
from corpusflow.llm.url_filter import Rule

RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


@query("op2_url_filter")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled table holds URLs that the rules decide; the model extends them to the others."""
    return judged(table(spark, folder, "pages"))


def judged(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url")
    decided = url_filter.with_parts(pages, RULES).filter("__url_fit.verdict IS NOT NULL")
    labelled = decided.select("url", (F.col("__url_fit.verdict") == "block").cast("int").alias("block"))
    out = url_filter.judge(pages, RULES, url_filter.train(labelled))
    return out.select(
        "page_id",
        *[F.col(f"__url_{c}").alias(c) for c in ("host", "path", "rule", "verdict", "score")],
    )
