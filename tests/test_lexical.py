from __future__ import annotations

import random
import re

import pytest

from corpusflow.operators import lexical


def brute_cover(terms, words):
    hits = [(at, w) for at, w in enumerate(words) if w in terms]
    spans = []
    for end in range(len(hits)):
        for start in range(end, -1, -1):
            if {w for _, w in hits[start : end + 1]} == set(terms):
                spans.append((start, end))
                break
    minimal = [
        (s, e) for s, e in spans if not any((s2, e2) != (s, e) and s <= s2 and e2 <= e for s2, e2 in spans)
    ]
    score = 0.0
    for s, e in minimal:
        score += 0.1 / (1 + (hits[e][0] - hits[s][0]) - (e - s))
    return round(score, 6)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    vocabulary = ["the"] * 12 + [f"w{i}" for i in range(12)]
    chunks = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(300)]
    queries = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 4)))) for i in range(80)]
    queries += [(500, "the the"), (501, "THE"), (502, "absent the"), (503, "  ,.")]
    return (
        spark.createDataFrame(queries, "query_id bigint, text string"),
        spark.createDataFrame(chunks, "chunk_id bigint, content string"),
        queries,
        chunks,
    )


def expected(queries, chunks, k):
    out = {}
    for q, text in queries:
        terms = set(re.findall(r"\w+", text.lower()))
        scored = [
            (-brute_cover(terms, words), c)
            for c, words in ((c, body.split()) for c, body in chunks)
            if terms and terms <= set(words)
        ]
        if scored:
            out[q] = [(c, -s) for s, c in sorted(scored)[:k]]
    return out


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.lexical))
    return out


def test_search_equals_brute_force(tables):
    queries, chunks, q, c = tables
    got = as_lists(lexical.lexical_search(queries, lexical.with_tokens(chunks), 7))
    assert got == expected(q, c, 7)


def test_salted_join_gives_the_same(tables, monkeypatch):
    queries, chunks, q, c = tables
    monkeypatch.setattr(lexical, "fits_broadcast", lambda *a, **k: False)
    got = as_lists(lexical.lexical_search(queries, lexical.with_tokens(chunks), 7))
    assert got == expected(q, c, 7)


def test_stored_statistics_give_the_same(tables):
    queries, chunks, q, c = tables
    stats = lexical.term_stats(lexical.build_postings(chunks))
    got = as_lists(lexical.lexical_search(queries, lexical.with_tokens(chunks), 3, stats=stats))
    assert got == expected(q, c, 3)


def test_equal_queries_get_equal_results(tables):
    queries, chunks, _, _ = tables
    got = as_lists(lexical.lexical_search(queries, lexical.with_tokens(chunks), 5))
    assert got[500] == got[501] and 502 not in got and 503 not in got


def test_no_list_of_a_frequent_term_is_shuffled(tables):
    queries, chunks, _, _ = tables
    plan = lexical.lexical_search(queries, lexical.with_tokens(chunks), 5)._jdf.queryExecution().executedPlan()
    assert "WindowGroupLimit" in plan.toString() and "CartesianProduct" not in plan.toString()


def test_postings_hold_positions(spark):
    chunks = spark.createDataFrame([(1, "B a, b!")], "chunk_id bigint, content string")
    rows = {r.term: (r.positions, r.tf) for r in lexical.build_postings(chunks).collect()}
    assert rows == {"b": ([1, 3], 2), "a": ([2], 1)}


def test_postings_are_built_without_a_shuffle(spark, tables):
    plan = lexical.build_postings(tables[1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_changed_postings_are_gained_changed_and_lost(spark):
    old = lexical.with_tokens(spark.createDataFrame([(1, "a b a"), (2, "x y"), (3, "same"), (4, "gone")], "chunk_id long, content string"))
    new = lexical.with_tokens(spark.createDataFrame([(1, "a b c"), (2, "y y"), (3, "same"), (5, "")], "chunk_id long, content string"))
    got = lexical.changed_postings(old, new, "lost").select("chunk_id", "term", "positions", "tf", "lost").collect()
    assert sorted(map(tuple, got)) == [
        (1, "a", [1], 1, False), (1, "c", [3], 1, False), (2, "x", [1], 1, True), (2, "y", [1, 2], 2, False), (4, "gone", [1], 1, True),
    ]


def test_words_nobody_probes_never_become_rows(tables, monkeypatch):
    """Only wanted terms leave a chunk's row; with more of them than are written out, the result is the same."""
    queries, chunks, q, c = tables
    worded = lexical.with_tokens(chunks)
    plan = lexical.lexical_search(queries, worded, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper() or " IN (" in plan.upper()
    monkeypatch.setattr(lexical, "TERM_SET", 1)
    assert as_lists(lexical.lexical_search(queries, worded, 7)) == expected(q, c, 7)


def test_tokens_at_hand_are_not_cut_again(tables):
    worded = lexical.with_tokens(tables[1]).localCheckpoint()
    plan = lexical.build_postings(worded)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
