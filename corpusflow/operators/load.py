"""Incremental load: diff, upsert, prune, cascade. Pure DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _status(old_seen: Column, new_seen: Column, same: Column, gone: str) -> Column:
    return (
        F.when(old_seen.isNull(), "new")
        .when(new_seen.isNull(), gone)
        .when(same, "unchanged")
        .otherwise("changed")
    )


def diff_documents(new: DataFrame, old: DataFrame) -> DataFrame:
    """new / changed / unchanged per incoming document, by source hash.

    Only key and hash travel through the join, never the text.
    """
    known = old.select("doc_id", F.col("source_hash").alias("__old"), F.lit(True).alias("__seen"))
    return (
        new.select("doc_id", "source_hash")
        .join(known, "doc_id", "left")
        .withColumn(
            "status",
            _status(F.col("__seen"), F.lit(True), F.col("source_hash").eqNullSafe(F.col("__old")), ""),
        )
        .select("doc_id", "source_hash", "status")
    )


def diff_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """new / changed / unchanged / removed per (doc_id, chunk_index)."""
    key = ["doc_id", "chunk_index"]
    left = new.select(*key, F.col("content_hash").alias("__new"))
    right = old.select(*key, F.col("content_hash").alias("__old"))
    return left.join(right, key, "full_outer").select(
        *key,
        _status(F.col("__old"), F.col("__new"), F.col("__new") == F.col("__old"), "removed").alias("status"),
    )


def load_stats(diff: DataFrame) -> DataFrame:
    """One row of counters: inserted, updated, skipped_unchanged, pruned."""
    def number(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return diff.agg(
        number("new").alias("inserted"),
        number("changed").alias("updated"),
        number("unchanged").alias("skipped_unchanged"),
        number("removed").alias("pruned"),
    )


def upsert(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    update_cols: list[str],
    coalesce_cols: list[str] | None = None,
) -> DataFrame:
    """Insert-or-update on ``keys``.

    Existing rows take ``update_cols`` from ``new`` and keep the rest (such as
    ``created_at``); a column in ``coalesce_cols`` is taken only when not null.
    ``new`` holds one row per key.
    """
    coalesce_cols = coalesce_cols or []
    seen_new = F.col("__new").isNotNull()
    seen_old = F.col("__old").isNotNull()

    def value(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name not in new.columns:
            return F.col(f"o.{name}").alias(name)
        fresh, kept = F.col(f"n.{name}"), F.col(f"o.{name}")
        if name in coalesce_cols:
            return F.coalesce(fresh, kept).alias(name)
        if name in update_cols:
            return F.when(seen_new, fresh).otherwise(kept).alias(name)
        return F.when(seen_old, kept).otherwise(fresh).alias(name)

    merged = (
        old.withColumn("__old", F.lit(True)).alias("o")
        .join(new.withColumn("__new", F.lit(True)).alias("n"), keys, "full_outer")
    )
    return merged.select(*[value(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds rows with unseen keys; inside the batch the first by ``order`` wins."""
    rest = [c for c in new.columns if c not in keys]
    first = (
        new.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("__first"))
        .select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])
    )
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def prune_chunks(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Drops stored chunks past the last index of the documents just loaded.

    A document that now has no chunk at all must be listed in ``current`` with a
    null ``chunk_index``; documents not listed are left alone.
    """
    last = current.groupBy("doc_id").agg(F.coalesce(F.max("chunk_index"), F.lit(-1)).alias("__last"))
    return (
        stored.join(last, "doc_id", "left")
        .filter(F.col("__last").isNull() | (F.col("chunk_index") <= F.col("__last")))
        .drop("__last")
    )


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``gone``; rows with a null key stay."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def set_null_where(df: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """Sets ``column`` to null where it points at a deleted key."""
    dead = gone.select(F.col(key).alias(column)).distinct().withColumn("__dead", F.lit(True))
    kind = df.schema[column].dataType
    return (
        df.join(dead, column, "left")
        .withColumn(column, F.when(F.col("__dead").isNull(), F.col(column)).cast(kind))
        .drop("__dead")
        .select(*df.columns)
    )


def delete_cascade(tables: dict[str, DataFrame], kind: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting sessions, documents or messages by key.

    session: messages, memory, uploaded documents and their chunks go too.
    document: its chunks and favourites go too.
    message: memories stay and lose their message reference.
    """
    out = dict(tables)

    def drop(name: str, dead: DataFrame, key: str) -> DataFrame | None:
        """Removes rows and returns the removed ones, for the next level."""
        if name not in out:
            return None
        removed = out[name].join(dead.select(key).distinct(), key, "left_semi")
        out[name] = without(out[name], dead, [key])
        return removed

    if kind == "session":
        drop("sessions", gone, "session_id")
        messages = drop("messages", gone, "session_id")
        drop("conversation_memory", gone, "session_id")
        if messages is not None and "conversation_memory" in out:
            out["conversation_memory"] = set_null_where(
                out["conversation_memory"], "message_id", messages, "id"
            )
        documents = drop("documents", gone, "session_id")
        drop("rag_chunks", gone, "session_id")
        if documents is not None:
            drop("rag_chunks", documents, "doc_id")
            drop("favorites", documents, "doc_id")
    elif kind == "document":
        for name in ("documents", "rag_chunks", "favorites"):
            drop(name, gone, "doc_id")
    elif kind == "message":
        drop("messages", gone, "id")
        if "conversation_memory" in out:
            out["conversation_memory"] = set_null_where(out["conversation_memory"], "message_id", gone, "id")
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return out
