"""Order-dependent operators that stay spread out when one group is huge.

A plain ``Window.partitionBy(group)`` sorts a whole group in one task. Here the
rows are range-partitioned by (group, order) once, so a large group spans many
tasks; only one summary row per (group, range) meets in the second step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.session import settled

RANGE = "__range"


def _ranged(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    # The range bounds come from a sample, so the tagged rows are settled
    # before two branches read them.
    return settled(
        df.repartitionByRange(*group, *order).withColumn(RANGE, F.spark_partition_id())
    )


def position_in_group(
    df: DataFrame, group: list[str], order: list[str], position: str = "pos", total: str = "n"
) -> DataFrame:
    """Exact 0-based position of each row in its group, and the group size."""
    tagged = _ranged(df, group, order)
    per_range = tagged.groupBy(*group, RANGE).agg(F.count(F.lit(1)).alias("__rows"))
    ranges = W.partitionBy(*group).orderBy(RANGE)
    offsets = per_range.select(
        *group,
        RANGE,
        F.coalesce(
            F.sum("__rows").over(ranges.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
        F.sum("__rows").over(W.partitionBy(*group)).alias(total),
    )
    local = tagged.withColumn(
        "__local", F.row_number().over(W.partitionBy(*group, RANGE).orderBy(*order)) - 1
    )
    return (
        local.join(offsets, [*group, RANGE])
        .withColumn(position, F.col("__before") + F.col("__local"))
        .drop("__local", "__before", RANGE)
    )


def with_next(
    df: DataFrame, group: list[str], order: list[str], value: Column, name: str = "next"
) -> DataFrame:
    """Adds ``value`` of the following row of the group (null on the last)."""
    return _with_neighbour(df, group, order, value, name, ahead=True)


def with_previous(
    df: DataFrame, group: list[str], order: list[str], value: Column, name: str = "previous"
) -> DataFrame:
    """Adds ``value`` of the preceding row of the group (null on the first)."""
    return _with_neighbour(df, group, order, value, name, ahead=False)


def _with_neighbour(
    df: DataFrame, group: list[str], order: list[str], value: Column, name: str, *, ahead: bool
) -> DataFrame:
    # A struct keeps "no neighbour" apart from "neighbour with a null value".
    tagged = _ranged(df.withColumn("__value", F.struct(value.alias("v"))), group, order)
    key = F.struct(*[F.col(c) for c in order])
    edge = F.min_by("__value", key) if ahead else F.max_by("__value", key)
    shift = F.lead if ahead else F.lag
    edges = (
        tagged.groupBy(*group, RANGE)
        .agg(edge.alias("__edge"))
        .withColumn("__across", shift("__edge").over(W.partitionBy(*group).orderBy(RANGE)))
        .drop("__edge")
    )
    local = tagged.withColumn(
        "__within", shift("__value").over(W.partitionBy(*group, RANGE).orderBy(*order))
    )
    return (
        local.join(edges, [*group, RANGE])
        .withColumn(name, F.coalesce("__within", "__across")["v"])
        .drop("__value", "__within", "__across", RANGE)
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int | Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; Spark keeps n per task before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)


def largest(df: DataFrame, column: str) -> int:
    """Largest value of a limit column, 0 for an empty table."""
    return int(df.agg(F.max(column)).first()[0] or 0)


def newest_per_key(df: DataFrame, key: list[str], order: Column, keep: list[str]) -> DataFrame:
    """One row per key, the one with the largest ``order``; combines map-side."""
    best = df.groupBy(*key).agg(F.max_by(F.struct(*keep), order).alias("__best"))
    return best.select(*key, *[F.col(f"__best.{c}").alias(c) for c in keep])
