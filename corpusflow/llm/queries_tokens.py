"""Queries of the tokenizer operators; no SQL twins, tests compare with direct encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import token_counts, token_files
from corpusflow.llm.common import shared_folder, table
from corpusflow.llm.registry import query


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Starts from an empty cache, so every distinct text is encoded."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cache = shared_folder(spark, "token-counts")
    counts = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op8_token_files")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_files.write_and_read(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
