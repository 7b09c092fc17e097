"""Query of the fingerprints; no SQL twin for the hashes, tests compare with a plain version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import winnow
from corpusflow.llm.common import table
from corpusflow.llm.registry import query


@query("op5_winnow")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


def fingerprints(docs: DataFrame) -> DataFrame:
    own = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .withColumn("chosen", winnow.chosen(F.col("text")))
        .select("doc_id", "text", "tie", winnow.digest(F.col("chosen")).alias("fingerprint"),
                winnow.run_hashes(F.col("chosen")).alias("runs"))
    )
    ahead = winnow.with_following(own, "doc_id", "tie", ["text", "runs"])
    changed = ahead.withColumn("edited", winnow.edited(F.col("text"), F.col("__next.text")))
    both = changed.withColumn("again", winnow.chosen(F.col("edited")))
    return both.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        winnow.digest(F.col("again")).alias("edited_fingerprint"),
        winnow.likeness(F.col("runs"), winnow.run_hashes(F.col("again"))).alias("near_edited"),
        winnow.likeness(F.col("runs"), F.col("__next.runs")).alias("near_next"),
    )
