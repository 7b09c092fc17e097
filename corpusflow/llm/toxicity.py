"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams (lower case, any blank as one
space). For each n-gram ``r = log(P(gram | toxic) / P(gram | clean))`` is counted
over all labelled training rows. The n-grams that tell the classes apart best
(largest ``(P1 - P0) * r``) become features with the value ``r`` if present, and
a logistic regression over them is fitted on a bounded sample.

Statistics run over every labelled row in tasks; each task adds up one fixed
table of counts, whatever its number of rows. The driver only ever holds the
``features`` best n-grams and at most ``fit_rows`` rows of feature numbers
(2 bytes each), both documented parameters.

Defined results: null and empty texts have no n-gram and get the base score;
without labelled rows of both classes every text gets the smoothed share of toxic
rows, 0.25 when there is none at all. Several labels of one document count as
their largest; repeated documents count as often as they occur. Null ids match
no label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.session import join_checked

SIZES = (4, 5, 6)
BITS = 20
FEATURES = 4096
FIT_ROWS = 12_000
SMOOTHING = 1.0
RIDGE = 1e-3
STEPS = 400


def gram_ids(text: str | None) -> np.ndarray:
    """Hash buckets of all character n-grams of a whole text, repeats included."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    chars[(chars >= 9) & (chars <= 13)] = 32
    found = []
    for n in SIZES:
        if len(chars) < n:
            break
        code = np.zeros(len(chars) - n + 1, dtype=np.uint64)
        for k in range(n):
            code *= np.uint64(0x9E3779B97F4A7C15)
            code += chars[k : len(chars) - n + 1 + k] + np.uint64(n)
        code *= np.uint64(0xD6E8FEB86659FD93)
        found.append((code >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def held_out(doc_id: Column) -> Column:
    """Rows no label is learnt from: CRC-32 of the id as text divides by five."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


@dataclass
class Model:
    """``place[bucket]``: number of the feature plus one, 0 for none; the last weight is the base."""

    place: np.ndarray
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        seen = np.unique(self.place[gram_ids(text)])
        margin = self.weights[-1] + self.weights[seen[seen > 0] - 1].sum()
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))))


def _gram_counts(labelled: DataFrame) -> DataFrame:
    """Rows of each class that hold each bucket: bucket, toxic rows, clean rows; bucket -1 counts the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = np.zeros(2, np.int64), np.zeros((2, 1 << BITS), np.int64)
        mark = np.zeros(1 << BITS, bool)
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                mark[gram_ids(text.as_py())] = True
                here = np.flatnonzero(mark)
                held[toxic, here] += 1
                mark[here] = False
                rows[toxic] += 1
        here = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": np.concatenate([[-1], here]).astype(np.int32),
                "toxic": np.concatenate([rows[1:], held[1, here]]),
                "clean": np.concatenate([rows[:1], held[0, here]]),
            }
        )

    counted = labelled.select("text", "toxic").mapInArrow(count, "bucket int, toxic long, clean long")
    return counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _fit(labels: np.ndarray, sets: list[np.ndarray], ratios: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; returns weight times ratio, base last."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    col = np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)
    value, n, k = ratios[col], max(len(sets), 1), len(ratios)
    # The step is safe for the largest row norm; the base counts as a feature of value one.
    step = 4.0 / (np.mean(np.bincount(row, value * value, len(sets)) + 1.0) + 4 * RIDGE)
    w = look = np.zeros(k + 1)
    for i in range(STEPS):
        margin = np.bincount(row, value * look[col], len(sets)) + look[k]
        error = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))) - labels
        slope = np.append(np.bincount(col, value * error[row], k) / n + RIDGE * look[:k], error.mean())
        new = look - step * slope
        look, w = new + (i / (i + 3)) * (new - w), new
    return np.append(w[:k] * ratios, w[k])


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    features: int = FEATURES,
    fit_rows: int = FIT_ROWS,
) -> Model:
    """Learns from the labels of documents that are not held out."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    texts = docs.select("doc_id", "text")
    counts = _gram_counts(join_checked(texts, known, "doc_id")).cache()
    try:
        total = counts.filter("bucket = -1").first()
        rows1, rows0 = (total["toxic"], total["clean"]) if total else (0, 0)
        place = np.zeros(1 << BITS, np.int16)
        if not rows1 or not rows0:
            share = (rows1 + 0.5) / (rows1 + rows0 + 2.0)
            return Model(place, np.array([np.log(share / (1 - share))]))
        p1 = (F.col("toxic") + SMOOTHING) / (rows1 + 2 * SMOOTHING)
        p0 = (F.col("clean") + SMOOTHING) / (rows0 + 2 * SMOOTHING)
        best = (
            counts.filter("bucket >= 0")
            .select("bucket", F.log(p1 / p0).alias("ratio"), ((p1 - p0) * F.log(p1 / p0)).alias("gain"))
            .orderBy(F.col("gain").desc(), "bucket")
            .limit(features)
            .toPandas()
        )
    finally:
        counts.unpersist()
    place[best["bucket"].to_numpy()] = np.arange(1, len(best) + 1)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    @F.pandas_udf("binary")
    def present(texts: pd.Series) -> pd.Series:
        found = (np.unique(place[gram_ids(t)]) for t in texts)
        return pd.Series([(f[f > 0] - 1).astype("<u2").tobytes() for f in found], dtype=object)

    # Rows of repeated ids count again, up to the same bound.
    fit = (
        join_checked(texts, sample, "doc_id")
        .select("doc_id", "toxic", present("text").alias("present"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("present"))
        .limit(fit_rows)
        .toPandas()
    )
    sets = [np.frombuffer(b, "<u2").astype(np.int64) for b in fit["present"]]
    return Model(place, _fit(fit["toxic"].to_numpy(float), sets, best["ratio"].to_numpy(float)))


def score(model: Model, text: Column) -> Column:
    """Score in [0, 1] of every whole text."""
    place, weights = model.place, model.weights

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = Model(place, weights)
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return scored(text)


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **options) -> DataFrame:
    """Documents with a score below ``limit``, all columns unchanged."""
    return docs.filter(score(train(docs, labels, **options), F.col("text")) < limit)
