from __future__ import annotations

import random

import numpy as np
import pytest

from corpusflow.llm import near_dedup as nd
from corpusflow.llm.components import components
from corpusflow.llm.grams import shingles, word_hashes
from tests.llm.cases import SCHEMA, awkward, prose, table


def shingle_set(text, words):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not ws:
        return frozenset()
    n = min(words, len(ws))
    return frozenset(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))


def plain(rows, words, percent):
    """Exact sets, all pairs, smallest reachable id."""
    sets = [shingle_set(r[1], words) for r in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    out = []
    for k, r in enumerate(rows):
        component = least.get(root(k)) if sets[k] else r[0]
        out.append((r[0], len(sets[k]), component, r[0] == component))
    return out


def key(x):
    return tuple((v is not None, v) for v in x)


def check(spark, rows, words, percent=80):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in
           nd.near_duplicates(table(spark, rows), words=words, percent=percent).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, words, percent), key=key)


def near(rng, text, changes):
    ws = text.split()
    for _ in range(changes):
        ws[rng.randrange(len(ws))] = f"z{rng.randrange(10**6)}"
    return " ".join(ws)


def test_awkward_rows(spark):
    check(spark, awkward(random.Random(1)), 2)


def test_groups_chains_and_borders(spark):
    rng = random.Random(2)
    rows, no = [], 100
    for _ in range(12):
        text = prose(rng, rng.randint(6, 120), 3000)
        for _ in range(rng.randint(1, 12)):
            rows.append((no, text, None, None, None, 0, "", "", ""))
            no += 1
            # Chains: each copy changes the one before, so the ends need not be alike.
            text = near(rng, text, rng.randint(0, max(1, len(text.split()) // 25)))
    rng.shuffle(rows)
    check(spark, rows, 2)
    check(spark, rows, 5)


def test_a_large_group_of_near_copies_is_one(spark):
    rng = random.Random(3)
    base = prose(rng, 200, 5000)
    rows = [(k, near(rng, base, 4), None, None, None, 0, "", "", "") for k in range(250)]
    rows += [(1000 + k, prose(rng, 60, 5000), None, None, None, 0, "", "", "") for k in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(table(spark, rows), words=2).collect()}
    assert all(got[k] == 0 for k in range(250)) and all(got[1000 + k] == 1000 + k for k in range(30))


def test_unlinked_look_alikes_are_compared_in_rows_and_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for group in range(3):
        base = prose(rng, 80, 5000)
        rows += [(group * 1000 + k, near(rng, base, rng.randint(2, 9)), None, None, None, 0, "", "", "") for k in range(60)]
    rng.shuffle(rows)
    check(spark, rows, 2)
    monkeypatch.setattr(nd, "FEW", 10)
    monkeypatch.setattr(nd, "BLOCK", 15)
    check(spark, rows, 2)


def test_blocks_are_also_bounded_by_shingles(spark, monkeypatch):
    rng = random.Random(10)
    base = prose(rng, 80, 5000)
    rows = [(k, near(rng, base, rng.randint(3, 9)), None, None, None, 0, "", "", "") for k in range(50)]
    rows += [(500 + k, prose(rng, 900, 5000), None, None, None, 0, "", "", "") for k in range(2)]
    monkeypatch.setattr(nd, "FEW", 5)
    monkeypatch.setattr(nd, "BLOCK_SET", 900)
    check(spark, rows, 2)


def test_hopeful_pairs_are_those_of_the_estimate():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    held = [np.concatenate([base[: 150 - cut], rng.integers(0, 2**63, cut + k, dtype=np.uint64)]) for k, cut in enumerate(range(0, 80, 5))]
    regs, sizes = np.stack([nd.sketch(x) for x in held]), np.array([len(x) for x in held])
    got = nd.hopeful(regs, regs, sizes, sizes, 80)
    for i in range(len(held)):
        for j in range(len(held)):
            value = nd.likely_jaccard(regs[[i]], regs[[j]], sizes[[i]].astype(float), sizes[[j]].astype(float))[0]
            near_sizes = 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j])
            if abs(value - (0.8 - nd.margin(80))) > 1e-6:
                assert got[i, j] == (near_sizes and value > 0.8 - nd.margin(80))


def test_values_that_share_nodes_are_one_crowd(spark):
    rows = [(b, v, f"{g}-{k}".encode(), f"{g}-{k}".encode()) for g in "ab" for b in range(4) for k in range(20) for v in [10 * (g == "b") + (k % (b + 1) == 0)]]
    members = spark.createDataFrame(rows, "band int, value long, node binary, label binary")
    crowds = nd._crowds(members).collect()
    assert len(crowds) == 40
    of = {}
    for r in crowds:
        of.setdefault(bytes(r["node"])[:1], set()).add(r["crowd"])
    assert {len(x) for x in of.values()} == {1} and of[b"a"] != of[b"b"]


def test_one_of_each_group_stays(spark):
    rows = awkward(random.Random(4))
    df = table(spark, rows)
    out = nd.keep_one(df, words=5)
    assert out.columns == df.columns
    ids = sorted(str(r["doc_id"]) for r in out.collect())
    # 1, 2, 4 and -5 share a component with -5 as least id; rows that repeat the kept one collapse.
    assert ids.count("-5") == 1 and not {"1", "2", "3", "4"} & set(ids)
    assert ids.count("10") == 1 and ids.count("11") == 1 and ids.count("12") == 2 and ids.count("13") == 2
    assert nd.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def row(no, text):
    return (no, text, None, None, None, 0, "", "", "")


def without_ids(rng):
    """Near, not equal, copies of which some or all rows have no id, a chain over such a row, and repeated ids."""
    bare, mixed, chain, twice = (prose(rng, 120, 5000) for _ in range(4))
    ws = chain.split()
    far = " ".join(ws[:100] + [f"x{k}" for k in range(20)])
    between = " ".join(ws[:100] + [f"x{k}" for k in range(10)] + ws[110:])
    return [
        [row(None, bare), row(None, bare.upper()), row(None, bare.replace(" ", "\n")), row(None, near(rng, bare, 2)), row(None, bare)],
        [row(21, mixed), row(None, near(rng, mixed, 2)), row(None, mixed + " more")],
        [row(31, chain), row(None, between), row(32, far)],
        [row(41, twice), row(41, near(rng, twice, 2)), row(41, twice), row(42, near(rng, twice, 2))],
        [row(51, prose(rng, 90, 5000))], [row(51, prose(rng, 90, 5000))], [row(None, prose(rng, 90, 5000))], [row(None, None)], [row(None, " ")],
    ]


def test_rows_without_ids_are_linked(spark):
    groups = without_ids(random.Random(10))
    rows = [r for g in groups for r in g]
    want = plain(rows, 2, 80)
    assert [w[2] for w in want[5:11]] == [21, 21, 21, 31, 31, 31]  # the chain needs the row between
    assert not linked(groups[2][0], groups[2][2])
    check(spark, rows, 2)


def linked(one, two):
    a, b = shingle_set(one[1], 2), shingle_set(two[1], 2)
    return 100 * len(a & b) >= 80 * len(a | b)


def test_one_row_of_each_group_stays_without_ids_and_with_repeated_ones(spark):
    groups = without_ids(random.Random(11))
    rows = [r for g in groups for r in g]
    out = [(r["doc_id"], r["text"]) for r in nd.keep_one(table(spark, rows), words=2).collect()]
    assert len(out) == len(groups)
    for g in groups:
        assert sum((r[0], r[1]) in out for r in {(r[0], r[1]) for r in g}) == 1
    assert sorted(str(i) for i, _ in out) == sorted(["None", "21", "31", "41", "51", "51", "None", "None", "None"])


def test_low_thresholds_lose_no_pair(spark):
    rng = random.Random(12)
    rows = []
    for k in range(60):
        ws = [f"p{k}x{j}" for j in range(90)]
        # 45 of 2 * 90 - 45 words are shared: a third.
        rows += [row(2 * k, " ".join(ws)), row(2 * k + 1, " ".join(ws[:45] + [f"q{k}x{j}" for j in range(45)]))]
    rng.shuffle(rows)
    assert len({p[2] for p in plain(rows, 1, 30)}) == 60
    check(spark, rows, 1, percent=30)
    check(spark, [r for r in rows if r[0] < 40], 1, percent=50)


def test_bands_follow_the_threshold():
    assert [nd.band_rows(p) for p in (100, 80, 50, 30)] == [4, 4, 2, 1]
    for p in range(11, 101):
        held = nd.band_rows(p)
        assert (1 - (p / 100) ** held) ** (128 // held) <= nd.MISS
    for p in (0, 5, 101):
        with pytest.raises(ValueError):
            nd.band_rows(p)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = values[:3000], values[500:]
    assert np.array_equal(nd.sketch(values), nd.merge(nd.sketch(a), nd.sketch(b)))
    for shared in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            cut = int(round(1000 * (1 - shared) / (1 + shared)))
            y = np.concatenate([x[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)])
            j = nd.likely_jaccard(nd.sketch(x)[None], nd.sketch(y)[None], np.array([1000.0]), np.array([1000.0]))[0]
            errors.append(j - (1000 - cut) / (1000 + cut))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_words_are_cut_like_bytes():
    rng = random.Random(6)
    for _ in range(200):
        data = "".join(rng.choice(["a", "B", "é", " ", "\t", "\x0b", "\x1c", "\xa0", "zz", "\n"]) for _ in range(rng.randint(0, 60))).encode()
        words = data.split()
        got = word_hashes(data)
        assert len(got) == len(words)
        seen = {}
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, got.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    long = ("abc " * 400_000).encode() + b"x" * 1_500_000 + b" end"
    assert len(word_hashes(long)) == 400_002 and len(shingles(long, 2)) == 3


def test_components_of_paths_and_stars(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 299), (299, 300), (5, 5)]
    rng.shuffle(edges)
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)} | {300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
