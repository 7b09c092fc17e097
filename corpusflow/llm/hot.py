"""A join for keys that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.session import BROADCAST_ROWS

#: Rows of one key that may meet in one task.
HOT = 4_096
# Every key is spread so far if the hot ones are too many to send to every task.
EVERY = 32


def join_counted(
    rows: DataFrame, small: DataFrame, key: str, n: str, spread: Column | None = None,
    hot: int = HOT, limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """``rows`` with the columns of ``small``, null where its key is missing.

    ``small`` is a stored table of narrow rows, one per key, whose column ``n`` says how
    many rows hold the key. A small table of at most ``limit`` rows goes to every task.
    Beyond that both sides are dealt by key, and a key of more than ``hot`` rows by
    key and ``spread`` as well: its one row is repeated for each part. ``spread`` must be
    the same whenever a row is computed again; by default it numbers the rows of a scan.
    """
    if small.count() <= limit:
        return rows.join(F.broadcast(small), key, "left")
    row_no = F.monotonically_increasing_id() if spread is None else F.xxhash64(spread)
    heavy = small.filter(F.col(n) > hot).select(key, F.ceil(F.col(n) / hot).cast("int").alias("__parts"))
    if heavy.count() <= limit:
        dealt = rows.join(F.broadcast(heavy), key, "left")
        parts = F.when(F.col(n) > hot, F.ceil(F.col(n) / hot)).otherwise(1).cast("int")
    else:
        dealt = rows.withColumn("__parts", F.lit(EVERY))
        parts = F.lit(EVERY)
    dealt = dealt.withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(row_no, "__parts")).cast("int")).drop("__parts")
    copies = small.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [key, "__part"], "left").drop("__part")
