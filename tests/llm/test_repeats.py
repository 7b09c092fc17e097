from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusflow.llm.common import words
from corpusflow.llm.repeats import repeats, without
from tests.llm.cases import SCHEMA, awkward, prose, table


def plain(rows, window):
    texts = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(t[k : k + window]) for t in texts for k in range(len(t) - window + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(t) - window + 1):
            if seen[tuple(t[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(t) if k not in gone)
        out.append((r[0], len(t), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, window, **options):
    got = repeats(table(spark, rows), window=window, **options).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == sorted(
        plain(rows, window), key=str
    )
    return got


@pytest.mark.parametrize(("window", "vocabulary"), [(1, 300), (2, 30), (5, 6), (9, 3), (35, 2)])
def test_short_vocabularies(spark, window, vocabulary, monkeypatch):
    monkeypatch.setattr("corpusflow.llm.repeats.FEW", 5)  # several prefix levels
    rng = random.Random(window)
    rows = [(k, prose(rng, rng.randint(0, 4 * window), vocabulary), None, None, None, 0, "", "", "") for k in range(60)]
    rows += rows[:3]
    check(spark, rows, window, group_windows=50)


def test_passages_in_many_documents(spark):
    rng = random.Random(1)
    shared = [prose(rng, rng.randint(34, 60), 10**6) for _ in range(3)]
    rows = []
    for k in range(150):
        parts = [prose(rng, rng.randint(0, 80), 10**6)]
        if k % 3 == 0:
            parts.append(shared[0])
        if k % 20 == 0:
            parts += [shared[1], prose(rng, 3, 10**6), shared[2], shared[2]]
        rng.shuffle(parts)
        rows.append((k, "\n".join(parts), None, None, None, 0, "", "", ""))
    got = check(spark, rows, 35)
    assert any(r["n_removed"] for r in got)
    by_id = {r[0]: r[1] for r in rows}
    cut = (
        spark.createDataFrame([(r["doc_id"], by_id[r["doc_id"]], r["spans"]) for r in got], "doc_id long, text string, spans array<int>")
        .select("doc_id", F.sha2(without(words(F.col("text")), F.col("spans")), 256).alias("s")).collect()
    )
    want = {r["doc_id"]: r["kept_sha256"] for r in got}
    assert all(r["s"] == want[r["doc_id"]] for r in cut)


def test_awkward_rows(spark):
    rows = awkward(random.Random(2))
    check(spark, rows, 35)
    assert repeats(spark.createDataFrame([], SCHEMA)).count() == 0
