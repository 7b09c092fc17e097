"""Sessions, messages and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators.context import ordered_text
from corpusflow.operators.load import upsert
from corpusflow.operators.ordered import top_per_group

# --- fixed values -----------------------------------------------------------
HISTORY_TURNS = 6
REWRITE_TURNS = 4
MAX_SESSIONS = 100
TITLE_CHARS = 80
TITLE_KEEP = 77
TITLE_EMPTY = "New chat"
RENAME_CHARS = 200
# ---------------------------------------------------------------------------


def derive_title(col: Column) -> Column:
    clean = tx.squeeze(F.coalesce(col, F.lit("")))
    return F.when(clean == "", F.lit(TITLE_EMPTY)).otherwise(tx.ellipsis(clean, TITLE_CHARS, TITLE_KEEP, "…"))


def owned(sessions: DataFrame, user: str) -> DataFrame:
    return sessions.filter(F.col("user_id") == user)


def message_summary(messages: DataFrame) -> DataFrame:
    """Per session: message count and first user question; combines map-side."""
    asked = F.col("role") == "user"
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min_by(
            F.when(asked, F.col("content")),
            F.when(asked, F.struct("created_at", "id")),
        ).alias("first_question"),
    )


def list_sessions(sessions: DataFrame, messages: DataFrame, limit: int = MAX_SESSIONS) -> DataFrame:
    """Sessions with messages, newest first, at most ``limit`` per user."""
    counted = sessions.join(message_summary(messages), "session_id")
    return top_per_group(
        counted, ["user_id"], [F.col("updated_at").desc(), F.col("session_id")], limit, "position"
    )


def rename_sessions(sessions: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """``changes``: session_id, user_id, title. Only the owner's rename counts."""
    clean = F.substring(tx.squeeze(F.coalesce("title", F.lit(""))), 1, RENAME_CHARS)
    allowed = (
        changes.join(sessions.select("session_id", "user_id"), ["session_id", "user_id"], "left_semi")
        .select("session_id", F.nullif(clean, F.lit("")).alias("title"), as_of.alias("updated_at"))
    )
    return upsert(sessions, allowed, ["session_id"], ["title", "updated_at"])


def append_messages(
    sessions: DataFrame, messages: DataFrame, new: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Adds turns; opens missing sessions, names untitled ones, bumps updated_at.

    ``new``: id, session_id, user_id, role, content, sources, metadata,
    created_at. Turns for a session of another user are dropped.
    """
    owners = sessions.select("session_id", F.col("user_id").alias("__owner"))
    allowed = new.join(owners, "session_id", "left").filter(
        F.col("__owner").isNull() | (F.col("__owner") == F.col("user_id"))
    ).drop("__owner")
    asked = F.col("role") == "user"
    touched = allowed.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
        F.min_by(
            F.when(asked, F.col("content")), F.when(asked, F.struct("created_at", "id"))
        ).alias("__question"),
    )
    named = touched.withColumn(
        "title", F.when(F.col("__question").isNotNull(), derive_title(F.col("__question")))
    ).drop("__question")
    merged = sessions.alias("o").join(named.alias("n"), "session_id", "full_outer").select(
        "session_id",
        F.coalesce("o.user_id", "n.user_id").alias("user_id"),
        F.coalesce("o.title", "n.title").alias("title"),
        F.coalesce("o.created_at", "n.created_at").alias("created_at"),
        F.greatest("o.updated_at", "n.updated_at").alias("updated_at"),
    )
    return merged, messages.unionByName(allowed.select(*messages.columns))


def list_messages(messages: DataFrame, sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages with their owner, oldest first; ``limit`` keeps the oldest per session."""
    mine = messages.join(sessions.select("session_id", "user_id"), "session_id")
    if limit is not None:
        mine = top_per_group(
            mine, ["session_id"], [F.col("created_at"), F.col("id")], limit, "position"
        ).drop("position")
    # A sort by range: a long session spans several tasks.
    return mine.orderBy("session_id", "created_at", "id")


def recent_history(messages: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """Last ``n`` turns per session, numbered from the oldest (``position``)."""
    last = top_per_group(
        messages, ["session_id"], [F.col("created_at").desc(), F.col("id").desc()], n, "__back"
    )
    oldest_first = W.partitionBy("session_id").orderBy(F.col("__back").desc())
    return last.withColumn("position", F.row_number().over(oldest_first)).drop("__back")


def alternate_turns(history: DataFrame) -> DataFrame:
    """Turns fit for a strict role alternation, ending on the assistant.

    Works on ``recent_history`` output, so a session has only a few rows here.
    Keeps known roles with text, the first of consecutive equal roles, and drops
    a user turn at the end.
    """
    order = W.partitionBy("session_id").orderBy("position")
    usable = history.filter(
        F.col("role").isin("user", "assistant") & (tx.trim_blank(F.coalesce("content", F.lit(""))) != "")
    )
    firsts = usable.withColumn("__before", F.lag("role").over(order)).filter(
        F.col("__before").isNull() | (F.col("__before") != F.col("role"))
    )
    marked = firsts.withColumn("__after", F.lead("role").over(order))
    return marked.filter((F.col("role") == "assistant") | F.col("__after").isNotNull()).drop("__before", "__after")


def transcript(history: DataFrame) -> DataFrame:
    """``User:`` / ``Assistant:`` text per session from a short history."""
    speaker = F.when(F.col("role") == "assistant", "Assistant").otherwise("User")
    line = F.concat(speaker, F.lit(": "), F.col("content"))
    return history.groupBy("session_id").agg(ordered_text(F.col("position"), line, "\n\n").alias("transcript"))


def followup_context(messages: DataFrame, questions: DataFrame, n: int = REWRITE_TURNS) -> DataFrame:
    """Rewrite input per question: the last turns of its session, then the question.

    Questions whose session has no turn yet need no rewrite and are left out.
    """
    spoken = transcript(recent_history(messages, n))
    return questions.join(spoken, "session_id").select(
        "query_id",
        F.concat(
            F.lit("Conversation so far:\n"), F.col("transcript"),
            F.lit("\n\nFollow-up question: "), F.col("text"),
            F.lit("\n\nStandalone search query:"),
        ).alias("rewrite_input"),
    )


def session_activity(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Message count with first and last time; empty sessions stay with 0."""
    per = messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("msgs"), F.min("created_at").alias("started"), F.max("created_at").alias("last")
    )
    return sessions.select("session_id", "user_id", "title").join(per, "session_id", "left").withColumn(
        "msgs", F.coalesce("msgs", F.lit(0))
    )
