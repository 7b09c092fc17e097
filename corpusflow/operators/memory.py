"""Cross-session memory: what to keep, how to recall it, how to forget it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators.encode import Encoder, embed
from corpusflow.operators.filters import PairRules
from corpusflow.operators.load import without
from corpusflow.operators.ordered import top_per_group, with_next
from corpusflow.operators.vector import knn_within
from corpusflow.session import fits_broadcast, join_checked

# --- fixed values -----------------------------------------------------------
RECALL_K = 3
PAIR_CHARS = 700
PREVIEW_CHARS = 200
LIST_CHARS = 100
MIN_SIMILARITY = 0.42
RECENCY_WEIGHT = 0.08
RECENCY_DAYS = 14
MIN_QUESTION_CHARS = 8
MIN_ANSWER_CHARS = 80
REFUSAL_HEAD_CHARS = 500
FINISHED = "end_turn"
CITATION = "\\[S\\d+\\]"
CHITCHAT = (
    "(?iu)^(hi|hello|hey|thanks|thank you|ok(?:ay)?|cool|nice|got it|sure|yes|no|yep|nope"
    "|sağol|təşəkkür|спасибо|привет|здравствуйте)[!.\\s]*$"
)
# Openings of a refusal; a word boundary stands before, none after.
REFUSALS = [
    "i (?:am )?(?:sorry|unable|cannot|can't|don't have|do not have)",
    "i'm (?:sorry|unable|afraid)",
    "could not find",
    "cannot find",
    "no (?:relevant|information|info|matches?)",
    "not (?:in the (?:provided )?sources?|in the available|mentioned|listed|available)",
    "the (?:provided )?sources? (?:do not|don't) (?:contain|mention|include)",
    "insufficient (?:sources|information)",
    "no data",
    "i'm just a",
    "i am (?:a|the) (?:real estate|research)",
    "please contact",
    "out of scope",
    "не содержат",
    "не имею",
    "извините",
    "не могу",
    "нет информации",
    "нет данных",
    "вне (?:моих|компетенции)",
    "üzr istəyirəm",
    "məlumat yoxdur",
    "tapa bilmirəm",
    "kömək edə bilmirəm",
]
# ---------------------------------------------------------------------------

REFUSAL = tx.word("|".join(REFUSALS), open_end=True)


def is_refusal(answer: Column) -> Column:
    head = F.substring(tx.trim_blank(F.coalesce(answer, F.lit(""))), 1, REFUSAL_HEAD_CHARS)
    return head.rlike(REFUSAL)


def _question(col: Column) -> Column:
    return tx.trim_blank(F.coalesce(col, F.lit("")))


def question_worth_keeping(question: Column) -> Column:
    """The part of the decision that looks at the question only."""
    q = _question(question)
    return (F.length(q) >= MIN_QUESTION_CHARS) & ~q.rlike(CHITCHAT)


def answer_worth_keeping(answer: Column) -> Column:
    """The part of the decision that looks at the answer only."""
    a = _question(answer)
    return (F.length(a) >= MIN_ANSWER_CHARS) & a.rlike(CITATION) & ~is_refusal(answer)


def memory_decision(question: Column, answer: Column) -> Column:
    """``ok``, or the first reason not to keep a question and answer pair."""
    q, a = _question(question), _question(answer)
    return (
        F.when((q == "") | (a == ""), "empty")
        .when(F.length(q) < MIN_QUESTION_CHARS, "question_too_short")
        .when(q.rlike(CHITCHAT), "chitchat")
        .when(F.length(a) < MIN_ANSWER_CHARS, "answer_too_short")
        .when(is_refusal(answer), "refusal")
        .when(~a.rlike(CITATION), "no_citations")
        .otherwise("ok")
    )


def format_pair(question: Column, answer: Column) -> Column:
    return F.concat(
        F.lit("Q: "), tx.truncate(question, PAIR_CHARS), F.lit("\nA: "), tx.truncate(answer, PAIR_CHARS)
    )


def reply_ids(messages: DataFrame) -> DataFrame:
    """(question_id, message_id): user turns followed directly by an assistant turn.

    Only ids, roles and times are ordered; the texts join later by id.
    """
    paired = with_next(
        messages.select("id", "session_id", "role", "created_at"),
        ["session_id"], ["created_at", "id"], F.struct("id", "role"), "reply",
    )
    return paired.filter((F.col("role") == "user") & (F.col("reply.role") == "assistant")).select(
        F.col("id").alias("question_id"), F.col("reply.id").alias("message_id")
    )


def _with_texts(ids: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    asked = questions.select(F.col("id").alias("question_id"), "session_id", F.col("content").alias("question"))
    given = answers.select(
        F.col("id").alias("message_id"), F.col("content").alias("answer"), "metadata", "created_at"
    )
    return ids.join(given, "message_id").join(asked, "question_id").drop("question_id")


def turn_pairs(messages: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it directly."""
    return _with_texts(
        reply_ids(messages), messages.filter("role = 'user'"), messages.filter("role = 'assistant'")
    )


def memory_rows(pairs: DataFrame) -> DataFrame:
    """Kept pairs with their memory text and previews; needs a finished answer."""
    finished = F.get_json_object("metadata", "$.stop_reason") == FINISHED
    kept = pairs.filter(finished & (memory_decision(F.col("question"), F.col("answer")) == "ok"))
    return _memory_columns(kept)


def _memory_columns(kept: DataFrame) -> DataFrame:
    return kept.select(
        F.col("message_id").alias("id"),
        *[c for c in ("user_id",) if c in kept.columns],
        "session_id",
        "message_id",
        format_pair(F.col("question"), F.col("answer")).alias("content"),
        tx.truncate(F.col("question"), PREVIEW_CHARS).alias("question"),
        tx.truncate(F.col("answer"), PREVIEW_CHARS).alias("answer_preview"),
        "created_at",
    )


def build_memory(
    messages: DataFrame, sessions: DataFrame, *, dim: int | None = 64, encoder: Encoder | None = None
) -> DataFrame:
    """Memory table from whole conversations; ``dim`` None leaves out the vector."""
    # Each side is cut down before the texts are joined.
    finished = F.get_json_object("metadata", "$.stop_reason") == FINISHED
    asked = messages.filter((F.col("role") == "user") & question_worth_keeping(F.col("content")))
    given = messages.filter((F.col("role") == "assistant") & finished & answer_worth_keeping(F.col("content")))
    owners = sessions.select("session_id", "user_id")
    rows = _memory_columns(_with_texts(reply_ids(messages), asked, given).join(owners, "session_id"))
    return rows if dim is None else embed(rows, "content", dim=dim, encoder=encoder)


def recall(queries: DataFrame, memory: DataFrame, as_of: Column, k: int = RECALL_K) -> DataFrame:
    """Best ``k`` memories per query from the same user's other sessions.

    ``queries``: query_id, user_id, session_id, embedding. Candidates are the
    nearest ``max(3k, k + 2)``; score = similarity plus a small bonus that fades
    with age; weak matches are dropped.
    """
    wide = max(k * 3, k + 2)
    near = knn_within(
        queries.filter("user_id IS NOT NULL"),
        memory.withColumnRenamed("id", "item_id"),
        wide,
        cell="user_id",
        rules=PairRules(other_session=True),
    ).filter(F.col("similarity") >= MIN_SIMILARITY)
    details = memory.select(
        F.col("id").cast("bigint").alias("item_id"),
        F.col("session_id").alias("memory_session"),
        "content",
        "created_at",
    )
    fits = fits_broadcast(queries, rows_each=wide)
    age_days = (F.unix_micros(as_of) - F.unix_micros("created_at")) / F.lit(86_400_000_000.0)
    scored = (
        join_checked(details, near.drop("rank"), "item_id", small_fits=fits)
        .withColumn("recency", F.round(F.exp(-age_days / F.lit(float(RECENCY_DAYS))), 6))
        .withColumn("score", F.round(F.col("similarity") + F.lit(RECENCY_WEIGHT) * F.col("recency"), 6))
        .withColumnRenamed("item_id", "memory_id")
    )
    chosen = top_per_group(
        scored, ["query_id"], [F.col("score").desc(), F.col("memory_id")], k, "position"
    )
    return chosen.withColumn("mid", F.concat(F.lit("M"), F.col("position").cast("string")))


def memory_stats(memory: DataFrame) -> DataFrame:
    return memory.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.max("created_at").alias("newest"), F.min("created_at").alias("oldest")
    )


def list_memory(memory: DataFrame) -> DataFrame:
    """Memories with a short preview, newest first per user."""
    return memory.select(
        "id", "user_id", "session_id", F.substring("content", 1, LIST_CHARS).alias("preview"), "created_at"
    ).orderBy("user_id", F.col("created_at").desc(), "id")


def clear(memory: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining rows, and the number deleted per user."""
    gone = users.select("user_id").distinct()
    deleted = memory.join(gone, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("deleted"))
    return without(memory, gone, ["user_id"]), deleted


def forget_users(memory: DataFrame, profiles: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memory and profile without the given users."""
    return without(memory, users, ["user_id"]), without(profiles, users, ["user_id"])
