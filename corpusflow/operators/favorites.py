"""Saved documents per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.load import upsert, without
from corpusflow.operators.ordered import top_per_group

# --- fixed values -----------------------------------------------------------
MAX_LISTED = 500
# ---------------------------------------------------------------------------


def list_favorites(favorites: DataFrame, documents: DataFrame, limit: int = MAX_LISTED) -> DataFrame:
    """Favourites with document columns, newest first, ``limit`` per user."""
    known = favorites.join(documents.select("doc_id"), "doc_id", "left_semi")
    last = top_per_group(known, ["user_id"], [F.col("created_at").desc(), F.col("id")], limit, "position")
    return last.join(documents.select("doc_id", "url", "title", "doc_type", "language"), "doc_id")


def mark_favorites(df: DataFrame, favorites: DataFrame, user: str | None = None) -> DataFrame:
    """Adds ``is_favorite``: for one user, or for the ``user_id`` of each row."""
    if user is not None:
        saved = favorites.filter(F.col("user_id") == user).select("doc_id").distinct()
        keys = ["doc_id"]
    else:
        saved = favorites.select("user_id", "doc_id").distinct()
        keys = ["user_id", "doc_id"]
    marked = df.join(saved.withColumn("__saved", F.lit(True)), keys, "left")
    return marked.withColumn("is_favorite", F.coalesce("__saved", F.lit(False))).drop("__saved")


def add_favorites(favorites: DataFrame, documents: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with ``new`` saved, and the rows rejected for an unknown document.

    Saving twice keeps one row; a null note leaves the earlier note.
    """
    accepted = new.join(documents.select("doc_id"), "doc_id", "left_semi")
    rejected = new.join(documents.select("doc_id"), "doc_id", "left_anti")
    # Within a batch the first save opens the row and the last given note wins.
    per_key = accepted.groupBy("user_id", "doc_id").agg(
        F.min("id").alias("id"),
        F.max_by("note", F.when(F.col("note").isNotNull(), F.struct("created_at", "id"))).alias("note"),
        F.min("created_at").alias("created_at"),
    )
    merged = upsert(favorites, per_key, ["user_id", "doc_id"], [], coalesce_cols=["note"])
    return merged, rejected


def remove_favorites(favorites: DataFrame, gone: DataFrame, *, by: str = "id") -> DataFrame:
    """Removes by ``id`` or by ``doc_id``, only rows of the asking user."""
    return without(favorites, gone, [by, "user_id"])


def update_notes(favorites: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: id, user_id, note; a null note clears it. Unknown rows are ignored."""
    known = changes.join(favorites.select("id", "user_id"), ["id", "user_id"], "left_semi")
    return upsert(favorites, known.select("id", "user_id", "note"), ["id", "user_id"], ["note"])


def favorites_stats(favorites: DataFrame) -> DataFrame:
    return favorites.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.max("created_at").alias("newest"))
