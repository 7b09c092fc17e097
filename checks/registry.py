"""One registry for queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # The given times carry no zone; both engines read them as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def flat(df: DataFrame) -> DataFrame:
    """Plain column types on both sides of the comparison.

    Whole numbers become bigint, fractions double, times whole seconds, dates text.
    """
    out = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind in ("integer", "short", "byte"):
            column = column.cast("bigint")
        elif kind in ("float", "decimal"):
            column = column.cast("double")
        elif kind == "timestamp":
            column = F.unix_timestamp(column)
        elif kind == "date":
            column = column.cast("string")
        out.append(column.alias(field.name))
    return df.select(*out)
