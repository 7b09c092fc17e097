"""Answer events to finished turns, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from corpusflow.operators import memory
from corpusflow.operators.encode import Encoder, embed
from corpusflow.streaming.run import use_state_store

# --- fixed values -----------------------------------------------------------
CLOSING = ["done", "error", "end"]
IDLE_MINUTES = 60
# ---------------------------------------------------------------------------

def flat_events(events: DataFrame) -> DataFrame:
    """request_id, seq, ts and ``event`` to one flat row per event."""
    return events.select(
        "request_id",
        F.col("seq").cast("bigint").alias("seq"),
        "ts",
        F.col("event.type").alias("type"),
        F.when(F.col("event.type") == "delta", F.col("event.text")).alias("text"),
        F.col("event.model").alias("model"),
        F.col("event.mode").alias("mode"),
        F.col("event.stop_reason").alias("stop_reason"),
        F.size("event.sources").cast("bigint").alias("n_sources"),
        F.col("event.usage.input_tokens").alias("in_tok"),
        F.col("event.usage.output_tokens").alias("out_tok"),
        F.when(F.col("event.type") == "error", F.coalesce("event.kind", F.lit("unknown"))).alias("kind"),
    )


def _assembled(events: GroupedData) -> DataFrame:
    """Text in order, last value of the rest; an event that arrives twice counts once.

    The answer text of one request is the result cell, so its pieces meet here.
    """
    def last(kind: str, column: str):
        return F.max_by(column, F.when(F.col("type") == kind, F.col("seq")))

    piece = F.when(F.col("type") == "delta", F.struct("seq", "text"))
    pieces = F.array_sort(F.collect_set(piece))
    return events.agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("content"),
        F.size(pieces).cast("bigint").alias("deltas"),
        last("model", "model").alias("model"),
        last("sources", "mode").alias("mode"),
        last("done", "stop_reason").alias("stop_reason"),
        last("sources", "n_sources").alias("n_sources"),
        last("usage", "in_tok").alias("in_tok"),
        last("usage", "out_tok").alias("out_tok"),
        last("error", "kind").alias("error_kind"),
        F.bool_or(F.col("type").isin(*CLOSING)).alias("__closed"),
    )


def assemble_turns(events: DataFrame) -> DataFrame:
    """One row per request that was closed."""
    return _assembled(events.groupBy("request_id")).filter("__closed").drop("__closed")


def assemble_turns_stream(events: DataFrame, late: str = "10 minutes", idle: str = f"{IDLE_MINUTES} minutes") -> DataFrame:
    """One row per request once it was silent for ``idle``, with ``closed_at``, the end of that silence.

    A session window per request: events may arrive in any order inside and across batches, and twice, as long as they
    are at most ``late`` behind. A request that was never closed is emitted with what it has; one that goes on after
    the silence begins another row. Open requests are all the state there is.
    """
    use_state_store(events.sparkSession)
    timed = events.withWatermark("ts", late).groupBy("request_id", F.session_window("ts", idle))
    return _assembled(timed).withColumn("closed_at", F.window_time("session_window")).drop("__closed", "session_window")


def memory_from_turns(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """Kept memories of finished turns; ``questions``: request_id, session_id,
    user_id, message_id, question, created_at."""
    return _remembered(turns.join(questions, "request_id"))


def _remembered(pairs: DataFrame) -> DataFrame:
    return memory.memory_rows(
        pairs.select(
            "user_id", "session_id", "message_id", "question", F.col("content").alias("answer"),
            F.to_json(F.struct("stop_reason")).alias("metadata"), "created_at",
        )
    )


def memory_stream(
    events: DataFrame, questions: DataFrame, *, late: str = "10 minutes", idle: str = f"{IDLE_MINUTES} minutes",
    longest: str = "1 day", dim: int = 64, encoder: Encoder | None = None,
) -> DataFrame:
    """Streams of answer events and of questions to a stream of embedded memories.

    A turn meets its question if it ends within ``longest`` after it. Both sides have a watermark and the interval bounds what is
    kept: a question waits ``longest`` for its turn, a turn as long as questions may be late. Only kept memories are encoded.
    """
    turns = assemble_turns_stream(events, late, idle)
    asked = questions.withWatermark("created_at", late).withColumnRenamed("request_id", "__request")
    within = (F.col("closed_at") >= F.col("created_at")) & (F.col("closed_at") <= F.col("created_at") + F.expr(f"INTERVAL {longest}"))
    return embed(_remembered(turns.join(asked, (F.col("request_id") == F.col("__request")) & within)), "content", dim=dim, encoder=encoder)
