"""Documents that no operator may stumble over."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, size string, key string, node string"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


def awkward(rng: random.Random) -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = prose(rng, 20_000, 5_000)
    base = prose(rng, 120)
    texts = [
        (1, base), (2, base), (3, base + " one more"), (4, base.upper()), (5, None), (6, ""), (7, " \t\n "),
        (8, "single"), (9, "two words"), (10, long), (11, prose(rng, 300)), (12, prose(rng, 300)),
        (12, prose(rng, 80)), (13, "Ünïcödé 🙂 " + prose(rng, 50)), (13, "Ünïcödé 🙂 " + prose(rng, 50)),
        (None, "no id " + prose(rng, 60)), (None, base), (None, None), (-5, base + " x"),
        (14, "<|endoftext|> 's " + prose(rng, 40)),
    ]
    sources = ["b", "a", None, "é", ""]
    rows = [
        (d, t, None if k % 7 == 0 else "en", sources[k % 5], None if t is None else len(t), k, "s", "k", None)
        for k, (d, t) in enumerate(texts)
    ]
    return rows + [rows[10], rows[10], rows[0]]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
