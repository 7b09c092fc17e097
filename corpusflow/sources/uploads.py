"""Upload parts as a table or as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import schemas


def read_upload_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.UPLOAD_PARTS).parquet(path)


def stream_upload_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.UPLOAD_PARTS).parquet(path)


def read_part_files(spark: SparkSession, path: str) -> DataFrame:
    """Files named ``<upload_id>.<part>.<total>.part`` with their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.part").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    bits = F.split(name, "\\.")
    return files.select(
        F.get(bits, F.lit(0)).alias("upload_id"),
        F.get(bits, F.lit(1)).try_cast("int").alias("part_index"),
        F.get(bits, F.lit(2)).try_cast("int").alias("total_parts"),
        F.col("content").alias("data"),
        F.col("modificationTime").alias("created_at"),
    )
