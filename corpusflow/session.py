"""Session set-up and the two cluster-wide helpers every job shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only while its row count is known to stay below this.
BROADCAST_ROWS = 500_000
# Folders of ``written`` rows that go when the step that writes them is over; None outside of such a step.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def get_spark(app: str = "corpusflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream state.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own; elsewhere a machine-local
    folder would not survive the loss of an executor, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if named:
        if not current:
            sc.setCheckpointDir(named)
        return named
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="corpusflow-")
    sc.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage.

    Used where two branches must see exactly the same rows (sampled range
    boundaries, trained cells) or where a costly step feeds several joins.
    """
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``settled``, for wide tables that are read in parts: Parquet in the shared folder, so texts and vectors lie there
    compressed and a reader takes only its columns."""
    path = f"{work_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    if (passing_now := _PASSING.get()) is not None:
        passing_now.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """One step of a long job: rows ``written`` in it are deleted at its end, so nothing lazy may leave it.

    Shuffle files and checkpoints nobody refers to any more go when the driver collects its garbage, which is asked for here: a
    driver with a large heap may else keep those of all steps.
    """
    token = _PASSING.set([])
    try:
        yield
    finally:
        for path in _PASSING.get() or []:
            drop_folder(spark, path)
        _PASSING.reset(token)
        gc.collect()
        spark._jvm.System.gc()


def fits_broadcast(df: DataFrame, rows_each: int = 1, limit: int = BROADCAST_ROWS) -> bool:
    """True when ``rows_each`` rows per row of ``df`` stay under the limit.

    A plain count: it reads no column it does not need and moves no row.
    """
    return df.count() * max(rows_each, 1) <= limit


def picked(rows: DataFrame, judged: DataFrame, wanted: Column, key: list[str]) -> DataFrame:
    """Rows whose key ``judged`` wants; every key of ``rows`` is judged, null keys never match.

    Wide rows stay where they are while either side of the judgement is small; only else are they shuffled.
    """
    yes, no = judged.filter(wanted).select(*key), judged.filter(~wanted).select(*key)
    named = rows.dropna(subset=key)
    others = no.count()
    if not others:
        return named
    if others <= BROADCAST_ROWS:
        return named.join(F.broadcast(no), key, "left_anti")
    return join_checked(named, yes, key, "left_semi")


def join_checked(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str] | Column,
    how: str = "inner",
    *,
    small_fits: bool | None = None,
) -> DataFrame:
    """Join that broadcasts ``small`` after a size check, else shuffles both."""
    fits = fits_broadcast(small) if small_fits is None else small_fits
    return big.join(F.broadcast(small) if fits else small, on, how)
