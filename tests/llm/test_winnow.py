from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import winnow
from corpusflow.llm.queries_winnow import fingerprints
from tests.llm.cases import SCHEMA, awkward, prose, table


def chosen(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    c = winnow.chosen(F.col("t"))
    rows = df.select("k", winnow.places(c).alias("p"), winnow.run_hashes(c).alias("h"), c.alias("c")).orderBy("k").collect()
    return [(r["p"], set(r["h"]), r["c"]) for r in rows]


def test_the_least_of_each_window_rightmost_of_equals(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 40), 3) for _ in range(60)] + ["a a a a a a a a a a", "", None, "one", "a b c d"]
    for text, (places, hashes, raw) in zip(texts, chosen(spark, texts), strict=True):
        words = (text or "").split()
        if not words:
            assert raw == []
            continue
        runs = len(words) - winnow.GRAM + 1
        if runs <= 0:
            assert places == [0] and len(hashes) == 1
            continue
        # All run hashes, from the texts of the runs alone.
        alone = chosen(spark, [" ".join(words[k : k + winnow.GRAM]) for k in range(runs)])
        value = [next(iter(a[1])) for a in alone]
        want = []
        for k in range(max(1, runs - winnow.WINDOW + 1)):
            window = range(k, min(runs, k + winnow.WINDOW))
            best = max(window, key=lambda i: (-(value[i] % 2**31), i))
            if best not in want:
                want.append(best)
        assert places == want and hashes == {value[i] for i in want}


def test_shared_words_in_a_row_share_a_fingerprint(spark):
    rng = random.Random(2)
    shared = prose(rng, winnow.GRAM + winnow.WINDOW - 1, 10**6)
    texts = [f"{prose(rng, 30, 10**6)} {shared} {prose(rng, 30, 10**6)}" for _ in range(20)]
    sets = [h for _, h, _ in chosen(spark, texts)]
    assert all(a & sets[0] for a in sets)


def plain(rows):
    order = sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        q = len(text) // 4
        out.append((r[0], len(text), hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n", [1, 2, 30, 700])
def test_edited_texts_follow_the_order_of_ids(spark, n):
    rng = random.Random(n)
    ids = rng.sample(range(-10_000, 10_000), n)
    rows = [(i, prose(rng, rng.randint(0, 30)) or None, None, None, None, 0, "", "", "") for i in ids]
    rows[0] = (None if n > 2 else rows[0][0], "Ünï 🙂 null id", *rows[0][2:])
    got = fingerprints(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(plain(rows), key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_awkward_rows(spark):
    rows = awkward(random.Random(3))
    got = fingerprints(table(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], []).append(r)
    assert by_text[1][0]["fingerprint"] == by_text[2][0]["fingerprint"] != by_text[3][0]["fingerprint"]
    assert by_text[5][0]["fingerprint"] == by_text[6][0]["fingerprint"] == by_text[7][0]["fingerprint"]
    assert by_text[5][0]["near_edited"] == 1.0
    assert 0.4 < by_text[10][0]["near_edited"] < 0.8 and by_text[10][0]["near_next"] < 0.2
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
