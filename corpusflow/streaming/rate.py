"""Fixed-window request counts on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.usage import RATE_MAX, RATE_WINDOW


def over_limit_stream(events: DataFrame, window: str = RATE_WINDOW, most: int = RATE_MAX, late: str = "10 minutes") -> DataFrame:
    """Callers above the limit, once their window is closed; late rows drop.

    Counts are kept per (caller, window); partial counts combine before the
    shuffle, so a very busy caller costs one row per task.
    """
    counts = (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.window("ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return counts.filter(F.col("requests") > most).select(
        "user_id", F.col("w.start").alias("window_start"), "requests"
    )
