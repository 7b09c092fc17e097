"""Uploaded documents and their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.load import delete_cascade
from corpusflow.operators.ordered import top_per_group

# --- fixed values -----------------------------------------------------------
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MAX_PARTS = 32
MAX_PART_BYTES = 4 * 1024 * 1024
MAX_TOTAL_BYTES = 50 * 1024 * 1024
PDF_HEAD = "%PDF-"
TTL_HOURS = 1
SESSION_UPLOADS = 50
LIBRARY_UPLOADS = 200
# ---------------------------------------------------------------------------


def _chunk_counts(chunks: DataFrame) -> DataFrame:
    return (
        chunks.filter("session_id IS NOT NULL")
        .groupBy("doc_id", "session_id")
        .agg(F.count(F.lit(1)).alias("chunk_count"))
    )


def list_uploads(documents: DataFrame, chunks: DataFrame, limit: int = SESSION_UPLOADS) -> DataFrame:
    """Uploads per session with chunk count, newest first."""
    uploads = documents.filter((F.col("doc_type") == "upload") & F.col("session_id").isNotNull())
    last = top_per_group(uploads, ["session_id"], [F.col("updated_at").desc(), F.col("doc_id")], limit, "position")
    return last.join(_chunk_counts(chunks), ["doc_id", "session_id"], "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0))
    )


def upload_library(
    documents: DataFrame, sessions: DataFrame, chunks: DataFrame, limit: int = LIBRARY_UPLOADS
) -> DataFrame:
    """Uploads per user across sessions, with the session title."""
    owners = sessions.select("session_id", "user_id", F.col("title").alias("session_title"))
    mine = documents.filter((F.col("doc_type") == "upload") & F.col("session_id").isNotNull()).join(owners, "session_id")
    last = top_per_group(mine, ["user_id"], [F.col("updated_at").desc(), F.col("doc_id")], limit, "position")
    return last.join(_chunk_counts(chunks), ["doc_id", "session_id"], "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0))
    )


def library_totals(library: DataFrame) -> DataFrame:
    return library.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("chunk_count").alias("chunks"),
        F.sum(F.coalesce("size_kb", F.lit(0))).alias("size_kb"),
    )


def delete_uploads(tables: dict[str, DataFrame], gone: DataFrame, user: str | None = None) -> dict[str, DataFrame]:
    """Deletes uploads given by (session_id, doc_id) with chunks and favourites.

    Only uploads of that very session count; ``user`` also checks the owner.
    """
    uploads = tables["documents"].filter(F.col("doc_type") == "upload").select("doc_id", "session_id")
    if user is not None:
        own = tables["sessions"].filter(F.col("user_id") == user).select("session_id")
        uploads = uploads.join(own, "session_id", "left_semi")
    allowed = gone.join(uploads, ["doc_id", "session_id"], "left_semi").select("doc_id")
    return delete_cascade(tables, "document", allowed)


def part_reason(has_session: bool = True) -> Column:
    """Why a part is rejected, tested in the order of the request checks; null when fine."""
    name = F.trim(F.coalesce("filename", F.lit("")))
    size = F.octet_length("data")
    reason = (
        F.when(~F.coalesce(F.col("upload_id").rlike(UUID), F.lit(False)), "upload_id_not_uuid")
        .when(F.col("part_index").isNull() | (F.col("part_index") < 0), "part_index_negative")
        .when(
            F.col("total_parts").isNull() | (F.col("total_parts") < 1) | (F.col("total_parts") > MAX_PARTS),
            "total_parts_out_of_range",
        )
        .when(F.col("part_index") >= F.col("total_parts"), "part_index_out_of_range")
        .when(~F.lower(name).endswith(".pdf"), "filename_not_pdf")
    )
    if has_session:
        bad = F.col("session_id").isNotNull() & (F.col("session_id") != "") & ~F.col("session_id").rlike(UUID)
        reason = reason.when(bad, "session_id_not_uuid")
    return (
        reason.when(F.col("data").isNull(), "part_missing")
        .when(size == 0, "part_empty")
        .when(size > MAX_PART_BYTES, "part_too_large")
    )


def validate_parts(parts: DataFrame) -> DataFrame:
    return parts.withColumn("reason", part_reason("session_id" in parts.columns))


def purge_stale(parts: DataFrame, as_of: Column, hours: int = TTL_HOURS) -> DataFrame:
    return parts.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def upload_status(parts: DataFrame) -> DataFrame:
    """Per upload: parts seen, bytes and status, without touching the bytes.

    A part sent twice counts once. The head of the file is put together from the
    first bytes of its parts: a first part may be shorter than the head.
    """
    unique = parts.groupBy("upload_id", "user_id", "part_index").agg(
        F.min_by(
            F.struct(
                F.octet_length("data").cast("bigint").alias("size"),
                F.col("total_parts"),
                F.col("filename"),
                F.substring("data", 1, len(PDF_HEAD)).alias("head"),
            ),
            "created_at",
        ).alias("p")
    )
    heads = F.array_sort(F.collect_list(F.struct("part_index", "p.head")))
    start = F.aggregate(heads, F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["head"]))
    per = unique.groupBy("upload_id", "user_id").agg(
        F.count(F.lit(1)).alias("have"),
        F.max("p.total_parts").alias("total_parts"),
        F.min("p.filename").alias("filename"),
        F.sum("p.size").alias("total_bytes"),
        F.substring(start, 1, len(PDF_HEAD)).alias("head"),
    )
    return per.withColumn(
        "status",
        F.when(F.col("have") < F.col("total_parts"), "incomplete")
        .when(F.col("total_bytes") > MAX_TOTAL_BYTES, "too_large")
        .when(~F.col("head").eqNullSafe(F.lit(PDF_HEAD).cast("binary")), "not_pdf")
        .otherwise("complete"),
    ).drop("head")


def assemble_uploads(parts: DataFrame) -> DataFrame:
    """Complete uploads with their bytes in part order.

    The status is decided on sizes first; only bytes of complete uploads, at
    most 50 MB each, are brought together.
    """
    status = upload_status(parts)
    ready = status.filter("status = 'complete'").select("upload_id", "user_id")
    unique = (
        parts.join(ready, ["upload_id", "user_id"], "left_semi")
        .groupBy("upload_id", "user_id", "part_index")
        .agg(F.min_by("data", "created_at").alias("data"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("part_index", "data")))
    whole = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["data"]))
    bodies = unique.groupBy("upload_id", "user_id").agg(whole.alias("data"))
    return status.join(bodies, ["upload_id", "user_id"], "left")
