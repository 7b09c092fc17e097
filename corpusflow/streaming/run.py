"""Running a stream to the end of its input, with state in the shared folder.

A stream takes ``spark.sql.shuffle.partitions`` of the session it is first started
in and keeps that number in its checkpoint for life: set it for the size the
stream shall grow to, not for the cluster it starts on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.session import work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State lives in RocksDB and is checkpointed, so it outlives executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Processes all available input into parquet and returns it as a table."""
    spark = stream.sparkSession
    root = fresh_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{root}/data")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    """Processes all available input with ``each`` once per micro-batch."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", state or f"{fresh_dir(spark, name)}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
