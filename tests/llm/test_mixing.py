from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.llm.mixing import apply_mix, mix
from tests.llm.cases import SCHEMA, awkward, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """Targets by repeated resharing, documents by sorting on their hash."""
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    source = [r[3] for r in rows]
    names = sorted({s for s in source if s is not None}, key=lambda s: [ord(c) for c in s]) + [None] * (None in source)
    total = {s: sum(n for n, o in zip(size, source, strict=True) if o == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, list(names), 1.5 * sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * total[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.remove(s)
    place = [int(hashlib.md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) for r in rows]
    taken = [0] * len(rows)
    for s in names:
        own = [k for k in range(len(rows)) if source[k] == s]
        passes = int(target[s] // total[s]) if total[s] else 0
        rest, before, last = target[s] - passes * total[s], 0, set()
        for h in sorted({place[k] for k in own}):
            group = [k for k in own if place[k] == h]
            here = sum(size[k] for k in group)
            if rest <= 0 or (before + here > rest and not (before + here - rest < rest - before)):
                break
            last |= set(group)
            before += here
            if before > rest:
                break
        for k in own:
            taken[k] = size[k] * (passes + (k in last))
    return [(r[0], size[k], total[source[k]], target[source[k]], taken[k]) for k, r in enumerate(rows)]


def got(df):
    return [
        (r["doc_id"], r["__mix_size"], r["__mix_source_size"], r["__mix_target"], r["__mix_taken"])
        for r in mix(df).collect()
    ]


def same(a, b):
    order = lambda x: (str(x[0]), x[1], x[2], x[4])
    for x, y in zip(sorted(a, key=order), sorted(b, key=order), strict=True):
        assert x[:3] == y[:3] and x[4] == y[4] and x[3] == pytest.approx(y[3])


def test_awkward_rows(spark):
    rows = awkward(random.Random(1))
    same(got(table(spark, rows)), plain(rows))


def test_many_documents_and_a_hot_source(spark):
    rng = random.Random(2)
    rows = [
        (k, prose(rng, rng.randint(0, 40)), "en", "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}", 0, 0, "", "", "")
        for k in range(1500)
    ]
    want = plain(rows)
    same(got(table(spark, rows)), want)
    by = {}
    for (_, size, total, target, taken), row in zip(want, rows, strict=True):
        assert taken <= 2 * size
        entry = by.setdefault(row[3], [0, target, total])
        entry[0] += taken
    assert all(abs(t - target) <= 40 for t, target, _ in by.values())


def test_the_mix_repeats_rows_and_keeps_columns(spark):
    rows = awkward(random.Random(3))
    df = table(spark, rows)
    out = apply_mix(df)
    assert out.columns == df.columns
    words = lambda d: d.agg(F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")))).first()[0]
    assert words(out) == sum(t[4] for t in plain(rows))
    assert out.filter("doc_id = 6").count() == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).count() == 0 and apply_mix(empty).count() == 0
