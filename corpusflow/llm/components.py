"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import settled

#: Edges one task reads at least.
TASK_ROWS = 100_000


def _star(edges: DataFrame) -> DataFrame:
    """Each node's neighbours next to the least of them and itself; one shuffle serves the least and the join."""
    dealt = edges.repartition("u")
    least = dealt.groupBy("u").agg(F.min("v").alias("m"))
    return dealt.join(least.select("u", F.least("u", "m").alias("m")), "u")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``edges`` (u, v) to (u, v): every node that has an edge and is not the least of its component, and that least.

    Large stars hook the larger neighbours of a node to its least neighbour, small
    stars the smaller ones, so chains halve and a hub costs one row per neighbour.
    Each round is written to the shared folder; it ends when a round changes nothing,
    or after ``rounds``: then a component may still have several stars, and the
    result is edges that connect the same nodes.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen, done = None, 0
    while True:
        large = _star(_each(edges, ("u", "v"), ("v", "u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _each(_star(large), ("v", "m"), ("u", "m")).filter("u <> v").distinct()
        edges = settled(small)
        done += 1
        if done == rounds:
            return edges
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == seen:
            return edges
        seen = now
        # A few rows in each of many files would be a few rows in each of many tasks.
        edges = edges.coalesce(now[0] // TASK_ROWS + 1)


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """One row (u, v) for each of the pairs of columns."""
    both = F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs])
    return rows.select(F.explode(both).alias("e")).select("e.u", "e.v")
