"""Identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doc_id(url: Column) -> Column:
    """Stable document id: first 16 hex digits of SHA-1 over the URL."""
    return F.substring(F.sha1(url), 1, 16)


def upload_doc_id(session_id: Column, filename: Column) -> Column:
    """Same session and file name give the same id, so a re-upload is an update."""
    return F.concat(
        F.lit("upload-"),
        F.substring(F.sha2(F.concat_ws("::", session_id, filename), 256), 1, 14),
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(doc: Column, index: Column) -> Column:
    """Surrogate id computed from the natural key, equal on every recompute."""
    return F.xxhash64(doc, index)


def store_bucket(doc: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")
