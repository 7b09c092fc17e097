"""User context, refresh decisions and profile upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators.load import upsert, without
from corpusflow.operators.ordered import newest_per_key, top_per_group

# --- fixed values -----------------------------------------------------------
TOPICS = 8
FAVORITES = 8
UPLOADS = 6
REFRESH_SECONDS = 60
REFRESH_DELTA = 3
TOPIC_CHARS = 160
SUMMARY_CHARS = 600
# ---------------------------------------------------------------------------


def distinct_on(df: DataFrame, keys: list[str], order: Column, keep: list[str]) -> DataFrame:
    """Newest row per key."""
    return newest_per_key(df, keys, order, keep)


def user_uploads(documents: DataFrame, sessions: DataFrame) -> DataFrame:
    """Uploaded documents with the user owning their session."""
    return documents.filter((F.col("doc_type") == "upload") & F.col("session_id").isNotNull()).join(
        sessions.select("session_id", "user_id"), "session_id"
    )


def recent_favorites(favorites: DataFrame, documents: DataFrame, n: int = FAVORITES) -> DataFrame:
    """Latest ``n`` per user; only the winners meet the document table."""
    known = favorites.join(documents.select("doc_id"), "doc_id", "left_semi")
    last = top_per_group(known, ["user_id"], [F.col("created_at").desc(), F.col("id")], n, "position")
    return last.select("user_id", "position", "doc_id", "note", "created_at").join(
        documents.select("doc_id", "title", "url"), "doc_id"
    )


def recent_topics(memory: DataFrame, n: int = TOPICS) -> DataFrame:
    last = top_per_group(
        memory.select("user_id", "id", "question", "created_at"),
        ["user_id"], [F.col("created_at").desc(), F.col("id")], n, "position",
    )
    return last.withColumn("topic", tx.trim_blank(F.coalesce("question", F.lit("")))).filter("topic != ''").select(
        "user_id", "position", "topic"
    )


def recent_uploads(documents: DataFrame, sessions: DataFrame, n: int = UPLOADS) -> DataFrame:
    """Newest upload per title, then the first ``n`` in title order."""
    newest = distinct_on(
        user_uploads(documents, sessions),
        ["user_id", "title"],
        F.struct("updated_at", "doc_id"),
        ["doc_id", "total_pages", "updated_at"],
    )
    return top_per_group(newest, ["user_id"], [F.col("title")], n, "position")


def signal_counts(memory: DataFrame, favorites: DataFrame, documents: DataFrame, sessions: DataFrame) -> DataFrame:
    """memory_n, favorite_n and upload_n per user, in one aggregation."""
    ones = [
        memory.select("user_id", F.lit("memory").alias("kind")),
        favorites.select("user_id", F.lit("favorite").alias("kind")),
        user_uploads(documents, sessions).select("user_id", F.lit("upload").alias("kind")),
    ]
    stacked = ones[0].unionByName(ones[1]).unionByName(ones[2])
    return stacked.groupBy("user_id").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"{kind}_n") for kind in ("memory", "favorite", "upload")]
    )


def _listed(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Per user an array in position order; at most a few rows each."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("position").alias("p"), value.alias("v"))))
    return df.groupBy("user_id").agg(F.transform(rows, lambda r: r["v"]).alias(name))


def user_context(
    sessions: DataFrame, documents: DataFrame, favorites: DataFrame, memory: DataFrame, profiles: DataFrame
) -> DataFrame:
    """One row per user with any signal or summary."""
    saved = _listed(
        recent_favorites(favorites, documents), F.struct("title", "url", "note", "created_at"), "favorites"
    )
    topics = _listed(recent_topics(memory), F.col("topic"), "topics")
    files = _listed(
        recent_uploads(documents, sessions), F.struct("title", "total_pages", "updated_at"), "uploads"
    )
    counts = signal_counts(memory, favorites, documents, sessions)
    out = counts.join(
        profiles.select("user_id", "summary", "refreshed_at"), "user_id", "full_outer"
    )
    for part in (saved, topics, files):
        out = out.join(part, "user_id", "left")
    filled = {name: F.coalesce(name, F.lit(0)) for name in ("memory_n", "favorite_n", "upload_n")}
    for name, frame in (("favorites", saved), ("topics", topics), ("uploads", files)):
        filled[name] = F.coalesce(F.col(name), F.array().cast(frame.schema[name].dataType))
    return out.withColumns(filled)


def profile_decision(counts: DataFrame, profiles: DataFrame, as_of: Column) -> DataFrame:
    """Per user: no_signals, no_change, throttled or refresh."""
    basis = profiles.select(
        "user_id", "basis_memory_n", "basis_favorite_n", "basis_upload_n", "refreshed_at", F.lit(True).alias("__known")
    )
    joined = counts.join(basis, "user_id", "full_outer")
    now = {k: F.coalesce(f"{k}_n", F.lit(0)) for k in ("memory", "favorite", "upload")}
    before = {k: F.coalesce(f"basis_{k}_n", F.lit(0)) for k in now}
    delta = sum((F.abs(now[k] - before[k]) for k in now), F.lit(0))
    total = now["memory"] + now["favorite"] + now["upload"]
    young = F.col("__known").isNotNull() & (
        F.unix_micros(as_of) - F.unix_micros("refreshed_at") < REFRESH_SECONDS * 1_000_000
    )
    return joined.select(
        "user_id",
        delta.alias("delta"),
        F.when(total == 0, "no_signals")
        .when(delta == 0, "no_change")
        .when((delta < REFRESH_DELTA) & young, "throttled")
        .otherwise("refresh")
        .alias("decision"),
    )


def profile_text(context: DataFrame) -> DataFrame:
    """Summariser input per user."""
    def section(title: str, name: str, line) -> Column:
        body = F.array_join(F.transform(name, line), "\n")
        return F.when(F.size(name) > 0, F.concat(F.lit(title + "\n"), body, F.lit("\n\n"))).otherwise(F.lit(""))

    head = F.concat(
        F.lit("Signals collected ("), F.col("memory_n").cast("string"), F.lit(" prior grounded Q&A, "),
        F.col("favorite_n").cast("string"), F.lit(" saved listings, "),
        F.col("upload_n").cast("string"), F.lit(" uploaded docs):\n\n"),
    )
    note = lambda f: F.coalesce(
        F.concat(F.lit(" (note: "), F.nullif(f["note"], F.lit("")), F.lit(")")), F.lit("")
    )
    pages = lambda u: F.when(
        F.coalesce(u["total_pages"], F.lit(0)) > 0,
        F.concat(F.lit(" ("), u["total_pages"].cast("string"), F.lit(" pages)")),
    ).otherwise(F.lit(""))
    return context.select(
        "user_id",
        F.concat(
            head,
            section("Saved listings:", "favorites", lambda f: F.concat(F.lit("- "), f["title"], note(f))),
            section(
                "Recent questions (most recent first):", "topics",
                lambda t: F.concat(F.lit("- "), F.substring(t, 1, TOPIC_CHARS)),
            ),
            section("Uploaded documents:", "uploads", lambda u: F.concat(F.lit("- "), u["title"], pages(u))),
            F.lit("Write the intent profile now."),
        ).alias("profile_text"),
    )


def upsert_profiles(profiles: DataFrame, summaries: DataFrame, counts: DataFrame, as_of: Column) -> DataFrame:
    """Stores new summaries with the counts they are based on; blank ones are skipped."""
    clean = F.substring(tx.squeeze(F.coalesce("summary", F.lit(""))), 1, SUMMARY_CHARS)
    fresh = (
        summaries.select("user_id", clean.alias("summary"))
        .filter("summary != ''")
        .join(counts, "user_id", "left")
        .select(
            "user_id",
            "summary",
            *[F.coalesce(f"{k}_n", F.lit(0)).alias(f"basis_{k}_n") for k in ("memory", "favorite", "upload")],
            as_of.alias("refreshed_at"),
            as_of.alias("updated_at"),
        )
    )
    changed = [c for c in profiles.columns if c != "user_id"]
    return upsert(profiles, fresh, ["user_id"], changed)


def clear_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    return without(profiles, users, ["user_id"])
