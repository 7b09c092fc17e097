from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corpusflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv int, depth string, p1 int, words string"


def said(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, said(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = own.get(base, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = Counter(), Counter()
    for node, held in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * words
    out = Counter()
    for node, held in members.items():
        ends = sorted(c for c in held if len(built[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out[min(held), len(node), parent, len(held), len(children[node]), leaves[node], saved[node], digest] += 1
    return out


def conversations(rng, n=160):
    texts = ["hi", "hello there", "what now\tthen", "", None, "a b c d"]
    rows = []
    for c in [*range(n), -3, -25, 1_000_000_007, 5_000]:
        for k in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, k, rng.choice(["user", None]), rng.choice(texts)))
    for c in range(2_000, 2_300):  # copies of one conversation, and tails of their own
        for k in range(5):
            rows.append((c, k, "user", f"same {k} words"))
        if c % 3 == 0:
            rows.append((c, 5, "assistant", f"own {c}"))
    rows += [(7, None, "user", "no turn"), (7, None, None, "no turn either"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (None, 0, "user", "lost")]
    for c in (3_000, 3_020, 3_041):  # long ones that share most of their turns
        rows += [(c, k, "user", f"turn {k % 7}" if k < 70 + c % 4 else f"end {c}") for k in range(90)]
    return [(*r, 1, "x", 2, "y") for r in rows]


@pytest.mark.parametrize(("block", "limit"), [(prefix_trie.BLOCK, 500_000), (8, 500_000), (16, 0)])
def test_equals_brute_force(spark, block, limit):
    rows = conversations(random.Random(block))
    got = Counter(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(6), block=block, limit=limit).collect()))
    want = plain(rows)
    assert got == want
    assert max(k[3] for k in want) > 300 and sum(k[3] == 1 for k in want) > 100


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    """Nothing is proven alone: every prefix is grouped exactly."""
    rows = conversations(random.Random(9), 60)
    monkeypatch.setattr(prefix_trie.Sketch, "estimate", lambda self, a, b: prefix_trie.np.full(len(a), 255, "uint8"))
    got = Counter(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows)


def test_estimates_are_never_too_small(spark):
    rows = spark.createDataFrame(conversations(random.Random(2)), SCHEMA)
    held = prefix_trie.prefixes(rows, 20).cache()
    judged = prefix_trie.screened(held).groupBy("p1", "p2").count().withColumnRenamed("count", "n")
    flags = prefix_trie.screened(held).select("p1", "p2", "alone").distinct().join(judged, ["p1", "p2"])
    assert flags.filter("alone AND n > 1").count() == 0
    assert flags.filter("NOT alone AND n = 1").count() < 0.05 * flags.filter("n = 1").count()


def test_empty_and_turnless(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 2)
    rows = [(c, 0, "user", "gone", 0, "", 0, "")]
    (row,) = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert tuple(row) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())
