"""Answer events as text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import schemas
from corpusflow.functions import text as tx


def event_payload(line: Column) -> Column:
    """JSON text of a ``data:`` line; null for blank, comment and other lines."""
    clean = tx.trim_blank(line)
    body = tx.trim_blank(F.substring(clean, 6, 1_000_000_000))
    return F.when(clean.startswith("data:") & (body != ""), body)


def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``event`` per readable line; everything else drops out.

    Works on a batch and on a stream alike.
    """
    payload = event_payload(F.col(column))
    return (
        lines.withColumn("__payload", payload)
        .filter(F.try_parse_json("__payload").isNotNull())
        .withColumn("event", F.from_json("__payload", schemas.ANSWER_EVENT))
        .drop("__payload")
    )


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_lines(spark.read.text(path))


def stream_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_lines(spark.readStream.text(path))
