from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusflow.session import get_spark

    folder = tmp_path_factory.mktemp("shared")
    session = get_spark(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(folder / "checkpoints"),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named texts."""
    from pyspark.sql import functions as F

    def value(make, *texts):
        row = spark.createDataFrame([(0,)], "i int").select(
            *[F.lit(t).alias(f"c{i}") for i, t in enumerate(texts)]
        )
        return row.select(make(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first()["v"]

    return value
