"""Token counts through a cache keyed by content and tokenizer digests.

Every text is named by the SHA-256 of its normalised content (null as empty; the
tokenizer's own normaliser is part of its definition, so nothing else may change
the text). Digests are looked up in a stored table of counts of the same
tokenizer version; only distinct contents that are missing are encoded, their
counts are appended to the table, and all documents read their count from it.

Copies are combined before the shuffle, so a text shared by a third of all rows
travels once per task and is encoded once. A run that stops half-way leaves only
whole appended batches; a digest appended twice counts once.

Defined results: null and empty texts have no byte and no token; repeated rows
each get their row; an empty table appends nothing and gives no row. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.tokenise import encoder

COUNTS = "version string, content binary, n_tokens long"


def version_digest(definition: str) -> str:
    """Names a tokenizer version: its definition and the library that runs it."""
    return hashlib.sha256(f"{tokenizers.__version__}\n{definition}".encode()).hexdigest()


def content_digest(text: str):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per content."""
    if not _exists(spark, cache):
        return spark.createDataFrame([], "content binary, n_tokens long")
    stored = spark.read.schema(COUNTS).parquet(cache).filter(F.col("version") == version)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens per document row; ``cache`` is a folder all executors share."""
    spark = docs.sparkSession
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    version = version_digest(definition)
    shipped = spark.sparkContext.broadcast(definition)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(shipped.value, version)
        for batch in batches:
            counts = [len(ids) // 4 for ids in known.encode(t.as_py() for t in batch.column("text"))]
            yield pa.RecordBatch.from_pydict(
                {"content": batch.column("content"), "n_tokens": pa.array(counts, pa.int64())}
            )

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), content_digest("text").alias("content"))
    if _exists(spark, cache):
        texts = texts.join(cached_counts(spark, cache, version), "content", "left_anti")
    misses = texts.groupBy("content").agg(F.first("text").alias("text"))
    (
        misses.mapInArrow(encode, "content binary, n_tokens long")
        .select(F.lit(version).alias("version"), "content", "n_tokens")
        .write.mode("append").parquet(cache)
    )
    named = docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
        content_digest("text").alias("content"),
    )
    return named.join(cached_counts(spark, cache, version), "content").select("doc_id", "n_bytes", "n_tokens")
