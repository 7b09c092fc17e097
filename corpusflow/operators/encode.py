"""Text to vector: a pluggable encoder slot and a built-in hashed-term encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import text as tx

# (texts, side) -> matrix with one row per text
Encoder = Callable[[list[str], str], np.ndarray]
VECTOR = T.ArrayType(T.FloatType())


def _slot(term: str, dim: int) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim


def _weights(tokens: pa.Array, dim: int, side: str) -> np.ndarray:
    """Unit rows of hashed term weights for a batch of token lists.

    Counting runs over the whole batch at once; each different term of the
    batch is hashed once.
    """
    rows = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
    coded = pc.list_flatten(tokens).dictionary_encode()
    terms = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy().astype(np.int64)
    slots = np.array([_slot(term, dim) for term in terms], dtype=np.int64)
    pairs, counts = np.unique(rows * max(len(terms), 1) + codes, return_counts=True)
    row, term = np.divmod(pairs, max(len(terms), 1))
    weight = np.ones(len(pairs)) if side == "query" else 1.0 + np.log(counts)
    if not len(pairs):
        return np.zeros((len(tokens), dim))
    out = np.bincount(row * dim + slots[term], weights=weight, minlength=len(tokens) * dim)
    out = out.reshape(len(tokens), dim)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1.0, norms)


def hashed_terms(tokens: Column, dim: int, side: str = "document") -> Column:
    """Unit vector of hashed term weights.

    A document weighs a term 1 + ln(count), a query weighs it 1. The tokens come
    from the JVM; only counting and hashing happen in the Python worker.
    """

    @F.arrow_udf(VECTOR)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = _weights(batch, dim, side).astype(np.float32).ravel()
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * dim
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return encode(tokens)


def model_vectors(text: Column, encoder: Encoder, dim: int, side: str, batch_size: int = 32) -> Column:
    """Vectors from any encoder; blank text is sent as one space."""

    @F.pandas_udf(VECTOR)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [(t or "").strip() or " " for t in batch]
            rows: list[np.ndarray] = []
            for start in range(0, len(texts), batch_size):
                part = texts[start : start + batch_size]
                got = np.asarray(encoder(part, side), dtype=np.float32)
                if got.shape != (len(part), dim):
                    raise ValueError(f"encoder returned {got.shape}, expected {(len(part), dim)}")
                rows.extend(got)
            yield pd.Series(rows)

    return encode(text)


def embed(
    df: DataFrame,
    text: str = "content",
    *,
    dim: int = 64,
    side: str = "document",
    encoder: Encoder | None = None,
    out: str = "embedding",
) -> DataFrame:
    if encoder is None:
        return df.withColumn(out, hashed_terms(tx.tokens(F.col(text)), dim, side))
    return df.withColumn(out, model_vectors(F.col(text), encoder, dim, side))


def wrong_dimension(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is missing or has another length."""
    return df.filter(F.coalesce(F.size(vector), F.lit(-1)) != dim)


def check_dim(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Same rows; the job fails on the first vector of another length."""
    size = F.coalesce(F.size(vector), F.lit(-1))
    message = F.concat(F.lit("vector of length "), size.cast("string"), F.lit(f", expected {dim}"))
    return df.withColumn(vector, F.when(size == dim, F.col(vector)).otherwise(F.raise_error(message)))
