from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from corpusflow.llm import variants
from tests.llm.cases import SCHEMA, awkward, table


def vocabulary(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    words = vocabulary(rows)
    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(close[w]), words.get(form[w])))
    return out


def edited(rng, word, letters):
    at, how = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + ("" if how == 0 else rng.choice(letters)) + word[at + (how != 1) :]


def crowd(rng):
    letters = "abÀz"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 13))) for _ in range(12)] + ["aaaaaaaa", "abababab", "commonprefix"]
    words = []
    for stem in stems:
        variant = [edited(rng, stem, letters) for _ in range(12)]
        deeper = [edited(rng, v, letters) for v in variant[:4] for _ in range(4)]
        words += [stem] * 260 + variant * 12 + deeper
    rng.shuffle(words)
    texts = [" ".join(words[k :: 60]) for k in range(60)] + [" ".join(words[k :: 60]).upper() for k in range(0, 60, 7)]
    return [(k, t, None, None, None, 0, "s", "k", "n") for k, t in enumerate(texts)]


def test_groups_equal_brute_force(spark):
    rng = random.Random(7)
    rows = awkward(rng) + crowd(rng)
    got = list(map(tuple, variants.group(table(spark, rows)).collect()))
    want = plain(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[1] is not None for r in got) > 100 and sum(r[2] not in (r[0], r[1]) for r in got) > 2


@pytest.mark.parametrize(("each", "together", "limit"), [(0, 1, 500_000), (1, 8, 0), (2, 100, 3)])
def test_crowded_groups_lose_and_repeat_no_pair(spark, each, together, limit):
    """Split to the last character, or only where crowded; with few and with many crowded keys."""
    rng = random.Random(each)
    words = sorted({edited(rng, w, "ab") for w in ["aaaaaaa", "abababab", "commonprefixa", "bbbbabbbb"] for _ in range(30)} | {"prefixed" + a + b for a in "abc" for b in "defg"} | {"aaaaaaa", "ab" * 40, "ab" * 39 + "a"})
    df = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n long")
    got = Counter(frozenset((r["a"], r["b"])) for r in variants.near_pairs(df, each, together, limit).collect())
    want = {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}
    assert set(got) == want and set(got.values()) == {1}


def test_a_shared_half_does_not_pair_all(spark):
    """A third of all words share their first half; what is joined stays in proportion to the words."""
    rng = random.Random(1)
    alone = {"".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(2_000)}
    shared = {"sharedhalf" + "".join(rng.choice("abcdefgh") for _ in range(10)) for _ in range(1_000)}
    df = spark.createDataFrame([(w, 2) for w in sorted(alone | shared)], "word string, n long")
    joined = []
    meet = variants._meet

    def counted(part):
        sizes = part.groupBy("key").pivot("gram", [False, True]).count().fillna(0)
        joined.append(sizes.selectExpr("sum(`false` * `true`)").first()[0] or 0)
        return meet(part)

    variants._meet = counted
    try:
        variants.near_pairs(df).collect()
    finally:
        variants._meet = meet
    assert sum(joined) < 40 * 3_000


def test_empty_and_wordless(spark):
    assert variants.group(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants.group(table(spark, [(1, "a b", None, None, None, 0, "", "", ""), (2, None, None, None, None, 0, "", "", "")])).count() == 0
