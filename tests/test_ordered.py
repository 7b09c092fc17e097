from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import context, ordered


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small ranges are not merged, so a group really spans several of them."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def rows_with_a_hot_group(n=3000):
    rng = random.Random(3)
    return pd.DataFrame(
        [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 30)}", rng.random(), i) for i in range(n)],
        columns=["g", "t", "id"],
    )


def test_position_is_exact_across_ranges(spark):
    frame = rows_with_a_hot_group()
    placed = ordered.position_in_group(spark.createDataFrame(frame), ["g"], ["t", "id"])
    got = placed.toPandas().set_index("id")
    # The hot group really spans several ranges.
    assert spark.createDataFrame(frame).repartitionByRange("g", "t").filter("g = 'hot'").select(
        F.spark_partition_id()
    ).distinct().count() > 1
    want = frame.sort_values(["g", "t", "id"])
    want = want.assign(pos=want.groupby("g").cumcount(), n=want.groupby("g").g.transform("size")).set_index("id")
    assert got.pos.sort_index().tolist() == want.pos.sort_index().tolist()
    assert got.n.sort_index().tolist() == want.n.sort_index().tolist()


def test_neighbours_cross_range_borders(spark):
    frame = rows_with_a_hot_group()
    df = spark.createDataFrame(frame)
    ahead = ordered.with_next(df, ["g"], ["t", "id"], F.col("id"), "after").toPandas().set_index("id")
    behind = ordered.with_previous(df, ["g"], ["t", "id"], F.col("id"), "before").toPandas().set_index("id")
    want = frame.sort_values(["g", "t", "id"])
    want = want.assign(after=want.groupby("g").id.shift(-1), before=want.groupby("g").id.shift(1)).set_index("id")
    assert ahead.after.sort_index().fillna(-1).tolist() == want.after.sort_index().fillna(-1).tolist()
    assert behind.before.sort_index().fillna(-1).tolist() == want.before.sort_index().fillna(-1).tolist()


def test_stride_positions(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)] + [("b", i) for i in range(5)], "g string, i int")
    got = context.stride_sample(df, ["g"], ["i"], 8).toPandas()
    assert sorted(got[got.g == "a"].i) == [0, 14, 28, 42, 57, 71, 85, 99]
    assert sorted(got[got.g == "b"].i) == [0, 1, 2, 3, 4]
    assert sorted(context.stride_sample(df, ["g"], ["i"], 1).toPandas().i) == [0, 0]


def test_newest_per_key_combines_map_side(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b")], "k string, t int, v string")
    best = ordered.newest_per_key(df, ["k"], F.col("t"), ["t", "v"])
    assert [tuple(r) for r in best.collect()] == [("k", 3, "c")]
    assert "partial_max_by" in best._jdf.queryExecution().executedPlan().toString()
