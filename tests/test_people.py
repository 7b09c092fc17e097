from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import favorites, memory, ordered, profile, sessions, uploads

NOW = datetime(2024, 3, 1)
LONG = "The flat costs 450,000 and has two bedrooms, a kitchen and a large balcony over the sea. [S1] "


def as_of():
    return F.to_timestamp(F.lit("2024-03-01 00:00:00"))


@pytest.mark.parametrize(
    "text,title", [(" Hello \n there ", "Hello there"), ("", "New chat"), ("x" * 80, "x" * 80), ("x" * 81, "x" * 77 + "…")]
)
def test_titles(one, text, title):
    assert one(sessions.derive_title, text) == title


def turns(spark, rows):
    return spark.createDataFrame(
        [(i, "s", role, text, "{}", NOW + timedelta(minutes=i)) for i, (role, text) in enumerate(rows)],
        "id bigint, session_id string, role string, content string, metadata string, created_at timestamp",
    )


def test_history_alternates_and_ends_on_the_assistant(spark):
    m = turns(spark, [("user", "a"), ("user", "b"), ("assistant", "c"), ("system", "z"), ("user", "d")])
    kept = sessions.alternate_turns(sessions.recent_history(m)).orderBy("position").collect()
    assert [(r.role, r.content) for r in kept] == [("user", "a"), ("assistant", "c")]


def test_only_the_newest_turns_count_as_history(spark):
    m = turns(spark, [("user" if i % 2 == 0 else "assistant", str(i)) for i in range(10)])
    assert [r.content for r in sessions.recent_history(m).orderBy("position").collect()] == list("456789")


@pytest.mark.parametrize(
    "question,answer,reason",
    [
        ("", "x", "empty"),
        ("thanks!", LONG, "question_too_short"),
        ("thank you!", LONG, "chitchat"),
        ("Здравствуйте", LONG, "chitchat"),
        ("What is the price?", "Cheap [S1]", "answer_too_short"),
        ("What is the price?", "I'm sorry, " + LONG, "refusal"),
        ("Какая цена?", "К сожалению, не могу ответить. " + LONG, "refusal"),
        ("Qiymət nədir?", "Üzr istəyirəm, " + LONG, "refusal"),
        ("What is the price?", LONG.replace("[S1]", ""), "no_citations"),
        ("What is the price?", LONG, "ok"),
        ("What is the price?", LONG + "x" * 500 + " no data", "ok"),
    ],
)
def test_memory_decision(one, question, answer, reason):
    assert one(memory.memory_decision, question, answer) == reason


def test_memory_needs_a_finished_answer_right_after_the_question(spark):
    done, cut = '{"stop_reason":"end_turn"}', '{"stop_reason":"max_tokens"}'
    rows = [("user", "What is the price?", "{}"), ("assistant", LONG, done), ("user", "And the second one?", "{}"),
            ("user", "Really, and that one?", "{}"), ("assistant", LONG, done), ("user", "And the last one?", "{}"), ("assistant", LONG, cut)]
    m = spark.createDataFrame(
        [(i, "s", r, c, j, NOW + timedelta(minutes=i)) for i, (r, c, j) in enumerate(rows)],
        "id bigint, session_id string, role string, content string, metadata string, created_at timestamp",
    )
    owners = spark.createDataFrame([("s", "u")], "session_id string, user_id string")
    kept = memory.build_memory(m, owners, dim=None).orderBy("id").collect()
    assert [(r.id, r.question) for r in kept] == [(1, "What is the price?"), (4, "Really, and that one?")]


def test_recall_skips_the_current_session_and_weak_matches(spark):
    rows = [
        (1, "u", "old", [1.0, 0.0], NOW - timedelta(days=14)),
        (2, "u", "now", [1.0, 0.0], NOW),
        (3, "u", "old", [0.0, 1.0], NOW),
        (4, "v", "old", [1.0, 0.0], NOW),
        (5, "u", None, [0.9, 0.1], NOW),
    ]
    m = spark.createDataFrame(
        rows, "id bigint, user_id string, session_id string, embedding array<float>, created_at timestamp"
    ).withColumn("content", F.lit("c"))
    asks = spark.createDataFrame(
        [(7, "u", "now", [1.0, 0.0]), (8, "u", None, [1.0, 0.0]), (9, None, None, [1.0, 0.0])],
        "query_id bigint, user_id string, session_id string, embedding array<float>",
    )
    got = memory.recall(asks, m, as_of()).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.mid, r.memory_id) for r in got] == [
        (7, "M1", 5), (7, "M2", 1), (8, "M1", 2), (8, "M2", 5), (8, "M3", 1),
    ]
    old = next(r for r in got if r.memory_id == 1)
    assert old.score == pytest.approx(1 + 0.08 * 0.367879, abs=1e-6)


def test_recall_of_a_hot_user_is_split(spark, monkeypatch):
    from corpusflow.operators import vector

    monkeypatch.setattr(vector, "GROUP_ITEMS", 20)
    m = spark.range(500).select(
        "id", F.lit("u").alias("user_id"), F.lit("old").alias("session_id"),
        F.array(F.lit(1.0), F.col("id") / 1000).cast("array<float>").alias("embedding"),
        as_of().alias("created_at"), F.lit("c").alias("content"),
    )
    asks = spark.createDataFrame([(1, "u", "x", [1.0, 0.0])], "query_id bigint, user_id string, session_id string, embedding array<float>")
    assert [r.memory_id for r in memory.recall(asks, m, as_of()).orderBy("position").collect()] == [0, 1, 2]


def saved(spark, rows):
    return spark.createDataFrame(rows, "id bigint, user_id string, doc_id string, note string, created_at timestamp")


def test_saving_again_keeps_the_note(spark):
    docs = spark.createDataFrame([("d",)], "doc_id string")
    first, bad = favorites.add_favorites(saved(spark, []), docs, saved(spark, [(1, "u", "d", "a", NOW), (2, "u", "x", None, NOW)]))
    assert [r.id for r in bad.collect()] == [2]
    again, _ = favorites.add_favorites(first, docs, saved(spark, [(3, "u", "d", None, NOW + timedelta(1))]))
    assert [tuple(r) for r in again.collect()] == [(1, "u", "d", "a", NOW)]


def test_only_the_owner_removes_and_edits(spark):
    rows = saved(spark, [(1, "u", "d", "a", NOW), (2, "v", "d", "b", NOW)])
    gone = spark.createDataFrame([(1, "v"), (2, "v")], "id bigint, user_id string")
    assert [r.id for r in favorites.remove_favorites(rows, gone).collect()] == [1]
    notes = spark.createDataFrame([(1, "u", None), (2, "u", "x")], "id bigint, user_id string, note string")
    assert {r.id: r.note for r in favorites.update_notes(rows, notes).collect()} == {1: None, 2: "b"}


@pytest.mark.parametrize(
    "now,basis,age,decision",
    [
        (0, 0, 10, "no_signals"), (4, 4, 10, "no_change"), (5, 4, 10, "throttled"),
        (5, 4, 61, "refresh"), (7, 4, 10, "refresh"), (1, None, None, "refresh"), (3, 4, 10, "throttled"),
    ],
)
def test_profile_decision(spark, now, basis, age, decision):
    counts = spark.createDataFrame([("u", now, 0, 0)], "user_id string, memory_n bigint, favorite_n bigint, upload_n bigint")
    known = [] if basis is None else [("u", basis, 0, 0, NOW - timedelta(seconds=age))]
    profiles = spark.createDataFrame(
        known, "user_id string, basis_memory_n bigint, basis_favorite_n bigint, basis_upload_n bigint, refreshed_at timestamp"
    )
    assert profile.profile_decision(counts, profiles, as_of()).first().decision == decision


def test_uploads_are_cut_in_title_order(spark):
    docs = spark.createDataFrame(
        [(f"d{i}", f"title {9 - i % 9}", "upload", "s", i, NOW + timedelta(i)) for i in range(18)],
        "doc_id string, title string, doc_type string, session_id string, total_pages bigint, updated_at timestamp",
    )
    owners = spark.createDataFrame([("s", "u")], "session_id string, user_id string")
    got = profile.recent_uploads(docs, owners).orderBy("position").collect()
    assert [r.title for r in got] == [f"title {i}" for i in range(1, 7)]
    assert all(int(r.doc_id[1:]) >= 9 for r in got)


UUID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def parts(spark, rows):
    return spark.createDataFrame(
        [(*r, NOW + timedelta(seconds=n)) for n, r in enumerate(rows)],
        "upload_id string, part_index int, total_parts int, filename string, user_id string, data binary, created_at timestamp",
    )


def test_parts_in_any_order_with_a_repeat(spark):
    rows = [(UUID, 2, 3, "a.pdf", "u", b"C"), (UUID, 0, 3, "a.pdf", "u", b"%PDF-A"), (UUID, 0, 3, "a.pdf", "u", b"%PDF-X"),
            (UUID, 1, 3, "a.pdf", "u", b"B")]
    row = uploads.assemble_uploads(parts(spark, rows)).first()
    assert (row.status, row.have, row.total_bytes, bytes(row.data)) == ("complete", 3, 8, b"%PDF-ABC")


@pytest.mark.parametrize(
    "rows,status",
    [
        ([(UUID, 0, 2, "a.pdf", "u", b"%PDF-")], "incomplete"),
        ([(UUID, 0, 1, "a.pdf", "u", b"GIF89")], "not_pdf"),
    ],
)
def test_upload_status(spark, rows, status):
    row = uploads.assemble_uploads(parts(spark, rows)).first()
    assert row.status == status and row.data is None


def test_too_large_uploads_are_not_assembled(spark, monkeypatch):
    monkeypatch.setattr(uploads, "MAX_TOTAL_BYTES", 6)
    row = uploads.assemble_uploads(parts(spark, [(UUID, 0, 1, "a.pdf", "u", b"%PDF-12")])).first()
    assert row.status == "too_large" and row.data is None


@pytest.mark.parametrize(
    "row,reason",
    [
        (("no", 0, 1, "a.pdf", "u", b"x"), "upload_id_not_uuid"),
        ((UUID, -1, 1, "a.pdf", "u", b"x"), "part_index_negative"),
        ((UUID, 0, 33, "a.pdf", "u", b"x"), "total_parts_out_of_range"),
        ((UUID, 2, 2, "a.pdf", "u", b"x"), "part_index_out_of_range"),
        ((UUID, 0, 1, "a.doc", "u", b"x"), "filename_not_pdf"),
        ((UUID, 0, 1, "a.pdf", "u", b""), "part_empty"),
        ((UUID, 0, 1, "a.pdf", "u", None), "part_missing"),
        ((UUID, 0, 1, "A.PDF", "u", b"x"), None),
    ],
)
def test_part_reasons(spark, row, reason):
    assert uploads.validate_parts(parts(spark, [row])).first().reason == reason


def test_stale_parts_are_purged(spark):
    rows = parts(spark, [(UUID, 0, 2, "a.pdf", "u", b"x")]).withColumn(
        "created_at", F.explode(F.array(as_of() - F.expr("INTERVAL 61 MINUTES"), as_of() - F.expr("INTERVAL 60 MINUTES")))
    )
    assert uploads.purge_stale(rows, as_of()).count() == 1


def test_top_per_group_prunes_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id")
    top = ordered.top_per_group(df, ["g"], [F.col("id").desc()], 2)
    assert sorted(r.id for r in top.collect()) == [94, 95, 96, 97, 98, 99]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
