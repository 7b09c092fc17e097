from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusflow.operators import context, filters, fusion
from corpusflow.plans import answer


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, rank int")


def test_rrf_of_ranks_one_and_three(spark):
    out = fusion.rrf([ranked(spark, [(1, 5, 1)]), ranked(spark, [(1, 5, 3), (1, 6, 1)])])
    scores = {r.chunk_id: r.rrf_score for r in out.collect()}
    assert scores[5] == pytest.approx(1 / 61 + 1 / 63, abs=1e-9) and round(scores[5], 6) == 0.032266
    assert scores[6] == pytest.approx(1 / 61, abs=1e-9)


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, rank int, text string, content string")


def test_rerank_orders_by_score_and_skips_a_single_candidate(spark):
    rows = candidates(spark, [(1, 10, 1, "red car", "blue boat"), (1, 11, 2, "red car", "red car here"), (2, 20, 1, "x", "y")])
    got = {(r.query_id, r.position): (r.chunk_id, r.rerank_score, r.reranked) for r in fusion.rerank(rows, 1).collect()}
    assert got == {(1, 1): (11, 1.0, True), (2, 1): (20, None, False)}


def test_failed_scorer_keeps_the_earlier_order(spark):
    def broken(asked, texts):
        raise RuntimeError("no service")

    rows = candidates(spark, [(1, 10, 1, "a", "b"), (1, 11, 2, "a", "a")])
    got = [(r.chunk_id, r.reranked) for r in fusion.rerank(rows, 5, broken).orderBy("position").collect()]
    assert got == [(10, False), (11, False)]


def test_own_scorer(spark):
    rows = candidates(spark, [(1, 10, 1, "a", "b"), (1, 11, 2, "a", "bbb")])
    longest = fusion.rerank(rows, 5, lambda asked, texts: [len(t) for t in texts])
    assert [r.chunk_id for r in longest.orderBy("position").collect()] == [11, 10]


def test_parameters_are_clamped(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 0, 3), (3, 99, 10)], "query_id bigint, top_k int, candidate_k int")
    got = [(r.top_k, r.candidate_k) for r in fusion.search_params(rows).orderBy("query_id").collect()]
    assert got == [(8, 32), (1, 3), (50, 50)]


@pytest.mark.parametrize("raw,shown", [('{"a": 1}', '{"a":1}'), ("[1]", "{}"), ("oops", "{}"), (None, "{}"), ("3", "{}")])
def test_metadata_is_parsed_leniently(spark, raw, shown):
    row = spark.createDataFrame([(raw,)], "m string").select(F.to_json(fusion.parse_metadata(F.col("m"))).alias("j"))
    assert row.first().j == shown


def test_range_filter_needs_a_value(spark):
    rows = spark.createDataFrame(
        [(1, (100.0, "en")), (2, (None, "en")), (3, (300.0, "ru"))],
        "id int, metadata struct<price: double, language: string>",
    )
    kept = filters.apply_filters(rows, {"price_min": 100, "price_max": 200, "language": "en"})
    assert [r.id for r in kept.collect()] == [1]
    assert filters.apply_filters(rows, {}).count() == 3


@pytest.mark.parametrize(
    "asked,wanted,changed",
    [
        ("3 otaqlı mənzil", "2-bedroom mənzil", True),
        ("4-комнатная", "3-bedroom", True),
        ("3 yataq otaqlı", "3 yataq otaqlı", False),
        ("1 otaqlı və 2 OTAQLI", "0-bedroom və 1-bedroom", True),
        ("0 otaqlı", "0 otaqlı", False),
        ("no rooms", "no rooms", False),
    ],
)
def test_room_counts_are_rewritten(spark, asked, wanted, changed):
    row = context.rewrite_rooms(spark.createDataFrame([(asked,)], "text string")).first()
    assert (row.rewritten, row.changed) == (wanted, changed)


@pytest.mark.parametrize(
    "asked,meta",
    [
        ("Summarize the PDF", True),
        ("analyse this doc", True),
        ("What does the contract say about fees?", True),
        ("overview please", True),
        ("How many bedrooms has the villa?", False),
        ("", False),
        ("please review " + "x " * 60, False),
    ],
)
def test_whole_document_requests(one, asked, meta):
    assert one(context.is_meta_doc, asked) is meta


def test_current_session_wins_over_other_uploads(spark):
    chunks = spark.createDataFrame(
        [(i, "d", i, "s1") for i in range(3)] + [(10 + i, "e", i, "s2") for i in range(30)] + [(99, "p", 0, None)],
        "chunk_id bigint, doc_id string, chunk_index int, session_id string",
    )
    sessions = spark.createDataFrame([("s1", "u"), ("s2", "u"), ("s3", "u")], "session_id string, user_id string")
    asks = spark.createDataFrame(
        [(1, "u", "s1", 8), (2, "u", "s3", 8), (3, "v", "s9", 8), (4, "u", "s2", 8)],
        "query_id bigint, user_id string, session_id string, top_k int",
    )
    rows = context.doc_chunks(chunks, sessions, asks).collect()
    of = lambda q: sorted(r.chunk_id for r in rows if r.query_id == q)
    assert of(1) == [0, 1, 2]
    assert len(of(2)) == 8 and {r.origin for r in rows if r.query_id == 2} == {"user"}
    assert of(3) == []
    assert len(of(4)) == 8 and {r.origin for r in rows if r.query_id == 4} == {"session"}


def test_prompt_leaves_out_empty_blocks(spark):
    queries = spark.createDataFrame([(1, "u", "Why?"), (2, None, "How?"), (3, "u", "No hit")], "query_id bigint, user_id string, text string")
    sources = spark.createDataFrame([(1, "S"), (2, "T")], "query_id bigint, sources_block string")
    memories = spark.createDataFrame([(1, "M")], "query_id bigint, memories_block string")
    profiles = spark.createDataFrame([("u", "")], "user_id string, profile_block string")
    got = {r.query_id: r.prompt for r in context.build_prompts(queries, sources, memories, profiles).collect()}
    assert got == {1: "M\nQuestion: Why?\nSources:\nS", 2: "Question: How?\nSources:\nT"}


@pytest.mark.parametrize("blank", [" ", " "])
def test_room_counts_with_other_blanks_are_rewritten(spark, blank):
    plain, other = (
        context.rewrite_rooms(spark.createDataFrame([(0, f"3{b}otaqlı mənzil")], "query_id int, text string")).first()["rewritten"]
        for b in (" ", blank)
    )
    assert plain == other != f"3{blank}otaqlı mənzil"


@pytest.mark.parametrize(
    ("wanted", "ids"),
    [
        ({"a": None}, [2]), ({"a": 5}, [0, 5]), ({"a": "5"}, [1]), ({"a": True}, [3]), ({}, [0, 1, 2, 3, 4, 5, 6, 7]),
        ({"b": {"c": 1}}, [4]), ({"l": [2]}, [6]), ({"l": [{"x": 1}]}, [6]), ({"l": [3, 2]}, []), ({"l": []}, [6]),
        ({"k.e'y": "v"}, [7]), ({"b": {}}, [4]),
    ],
)
def test_json_containment(spark, wanted, ids):
    texts = ['{"a": 5}', '{"a": "5"}', '{"a": null}', '{"a": true}', '{"b": {"c": 1, "d": 2}}', '{"a": 5.0, "z": 1}',
             '{"l": [1, 2, {"x": 1, "y": 2}]}', '{"k.e\'y": "v"}', "[1]", "oops", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, meta string")
    assert sorted(r.id for r in filters.contains(rows, wanted, "meta").collect()) == ids


def test_blank_questions_find_nothing(spark):
    chunks = spark.createDataFrame([(1, ["a"], [1.0, 0.0]), (2, ["b"], [0.0, 1.0])], "chunk_id long, tokens array<string>, embedding array<double>")
    asked = spark.createDataFrame(
        [(1, "  \n", [1.0, 0.0]), (2, "a", [1.0, 0.0])], "query_id long, text string, embedding array<double>"
    )
    assert {r.query_id for r in fusion.hybrid_search(asked, chunks, 3).collect()} == {2}


@pytest.mark.parametrize(("value", "text"), [(12345678.5, "12345678.5"), (5.0, "5"), (0.25, "0.25"), (1e15, "1000000000000000"), (None, None)])
def test_plain_numbers(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(context.plain_number(F.col("v")).alias("t")).first()["t"] == text


def test_only_questions_that_want_it_reach_the_scorer(spark):
    def longest(asked, texts):
        if "off" in asked or "single" in asked:
            raise RuntimeError("was not to be scored")
        return [len(t) for t in texts]

    rows = spark.createDataFrame(
        [(1, 10, 1, "on", "b", True), (1, 11, 2, "on", "bbb", True), (2, 20, 1, "off", "b", False), (2, 21, 2, "off", "bbb", False),
         (3, 30, 1, "unset", "b", None), (3, 31, 2, "unset", "bbb", None), (4, 40, 1, "single", "b", True)],
        "query_id bigint, chunk_id bigint, rank int, text string, content string, again boolean",
    )
    seen = Observation()
    got = {(r.query_id, r.position): (r.chunk_id, r.rerank_score) for r in fusion.rerank(rows, 1, longest, wanted="again", failures=seen).collect()}
    assert got == {(1, 1): (11, 3.0), (2, 1): (20, None), (3, 1): (31, 3.0), (4, 1): (40, None)}
    assert seen.get == {"failed_batches": 0, "failed_pairs": 0}


def test_failed_batches_are_observed_and_spare_the_others(spark):
    def shaky(asked, texts):
        if "bad" in asked:
            raise RuntimeError("no service")
        return [len(t) for t in texts]

    rows = candidates(spark, [(q, 10 * q + c, c, "bad" if q == 2 else "good", "x" * c) for q in (1, 2) for c in (1, 2, 3)])
    seen = Observation()
    parted = rows.repartition(2, "query_id")
    best = {r.query_id: (r.chunk_id, r.reranked) for r in fusion.rerank(parted, 1, shaky, failures=seen).collect()}
    assert best[2] == (21, False) and seen.get["failed_batches"] >= 1 and seen.get["failed_pairs"] in (3, 6)
    assert best[1] == ((13, True) if seen.get["failed_pairs"] == 3 else (11, False))


def test_choices_of_questions(spark):
    rows = spark.createDataFrame([(1, "VECTOR", False), (2, None, None), (3, "odd", True)], "query_id bigint, mode string, rerank boolean")
    got = [(r.mode, r.rerank) for r in answer.chosen(rows).orderBy("query_id").collect()]
    assert got == [("vector", False), ("hybrid", True), ("hybrid", True)]
    assert [(r.mode, r.rerank) for r in answer.chosen(rows.select("query_id")).collect()] == [("hybrid", True)] * 3
