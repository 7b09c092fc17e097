"""A training-data pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next one's documents. All but the last return the
columns of ``documents``: toxic documents go, one document of each group of near
duplicates stays, documents that hold a benchmark item go, sources are mixed to
their target weights (a document taken twice is two rows, one not taken is gone),
and what is left is written as token ids; the last stage returns what those files
hold, one row per document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import decontaminate, mixing, near_dedup, token_files, toxicity
from corpusflow.llm.common import shared_folder, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, words=5, percent=80)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_unseen(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, weights=(5, 2, 1), share=1.5, repeats=2)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, remembered=16 << 20)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_items),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# Trained weights, edit distances and tokenizers have no SQL form; tests/llm runs the
# stages on a small table against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
