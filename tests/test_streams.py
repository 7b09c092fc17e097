from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusflow.sources import tables
from corpusflow.streaming import ingest, rate, run, signals, turns, uploads

NOW = datetime(2024, 3, 1)
UUID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def stream(spark, path, batches, schema):
    """One file, and so one micro-batch, per list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


EVENT = (
    "request_id string, seq bigint, ts timestamp, type string, text string, model string, mode string,"
    " stop_reason string, n_sources bigint, in_tok bigint, out_tok bigint, kind string"
)


def event(request, seq, type_, /, **given):
    fields = ["text", "model", "mode", "stop_reason", "n_sources", "in_tok", "out_tok", "kind"]
    return (request, seq, NOW + timedelta(seconds=seq), type_, *[given.get(f) for f in fields])


def test_events_out_of_order_across_batches_and_repeated(spark, tmp_path):
    a = [event("a", 0, "sources", mode="hybrid", n_sources=2), event("a", 1, "delta", text="Hel"),
         event("a", 2, "delta", text="lo"), event("a", 3, "done", stop_reason="end_turn")]
    b = [event("b", 0, "delta", text="x"), event("b", 1, "error", kind="overloaded")]
    ahead = event("z", 0, "delta", text="!")
    ahead = (*ahead[:2], NOW + timedelta(days=2), *ahead[3:])
    batches = [[a[3], a[1], b[0]], [a[1], b[1]], [a[2], a[0], a[3]], [a[1], b[0]], [ahead]]
    df = stream(spark, str(tmp_path / "in"), batches, EVENT)
    out = run.run_to_table(turns.assemble_turns_stream(df), "turns").drop("closed_at")
    got = {r.request_id: r for r in out.collect()}
    assert len(got) == out.count() == 2
    assert (got["a"].content, got["a"].deltas, got["a"].stop_reason, got["a"].n_sources) == ("Hello", 2, "end_turn", 2)
    assert (got["b"].content, got["b"].error_kind) == ("x", "overloaded")
    batch = turns.assemble_turns(spark.createDataFrame(a + b + a, EVENT))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, out.collect()))


def test_a_silent_request_is_emitted_when_its_window_ends(spark, tmp_path):
    late = event("z", 0, "delta", text="!")
    late = (late[0], late[1], NOW + timedelta(days=2), *late[3:])
    batches = [[event("a", 0, "delta", text="half")], [late], [(*late[:1], 1, *late[2:])]]
    out = run.run_to_table(turns.assemble_turns_stream(stream(spark, str(tmp_path / "in"), batches, EVENT)), "turns")
    assert [(r.request_id, r.content, r.stop_reason) for r in out.collect() if r.request_id == "a"] == [("a", "half", None)]


PART = (
    "upload_id string, part_index int, total_parts int, filename string, user_id string, session_id string,"
    " data binary, created_at timestamp"
)


def part(index, data, minutes=0):
    return (UUID, index, 3, "a.pdf", "u", None, data, NOW + timedelta(minutes=minutes))


def test_upload_completes_once_from_parts_in_any_order(spark, tmp_path):
    batches = [[part(2, b"C")], [part(0, b"%PDF-A"), part(2, b"C")], [part(1, b"B")], [part(0, b"%PDF-A")]]
    out = run.run_to_table(uploads.complete_uploads_stream(stream(spark, str(tmp_path / "in"), batches, PART)), "up")
    assert [(r.status, r.total_bytes, bytes(r.data)) for r in out.collect()] == [("complete", 8, b"%PDF-ABC")]


def test_the_earliest_of_a_repeated_part_counts_in_any_order(spark, tmp_path):
    # A retry that arrives first, in the same batch and in an earlier one.
    batches = [[part(1, b"retry", 9), part(0, b"%PDF-again", 8), part(0, b"%PDF-A", 1)], [part(1, b"B", 2)], [part(2, b"C", 3), part(1, b"late", 99)]]
    out = run.run_to_table(uploads.complete_uploads_stream(stream(spark, str(tmp_path / "in"), batches, PART)), "up")
    assert [bytes(r.data) for r in out.collect()] == [b"%PDF-ABC"]


def test_abandoned_parts_expire(spark, tmp_path):
    other = ("1" + UUID[1:], 0, 2, "b.pdf", "u", None, b"%PDF-", NOW + timedelta(days=1))
    batches = [[part(0, b"%PDF-A"), part(1, b"B")], [other], [(*other[:1], 1, *other[2:])], [part(2, b"C", 60 * 30)]]
    out = run.run_to_table(uploads.complete_uploads_stream(stream(spark, str(tmp_path / "in"), batches, PART)), "up")
    assert [r.filename for r in out.collect()] == ["b.pdf"]


def test_refresh_waits_for_three_signals_or_a_minute(spark, tmp_path):
    at = [0, 10, 20, 30, 40, 130, 140]
    rows = [(7, NOW + timedelta(seconds=s)) for s in at]
    df = stream(spark, str(tmp_path / "in"), [rows[:3], rows[3:]], "user_id bigint, ts timestamp")
    out = run.run_to_table(signals.profile_triggers_stream(df), "triggers")
    got = [((r.fired_at - NOW).seconds, r.signals) for r in out.orderBy("fired_at").collect()]
    assert got == [(0, 1), (30, 3), (130, 2)]


def test_idle_users_leave_the_state(spark, tmp_path):
    batches = [[(u, NOW) for u in range(20)], [(100, NOW + timedelta(hours=30))], [(100, NOW + timedelta(hours=31)), (3, NOW + timedelta(hours=31))], [(100, NOW + timedelta(hours=32))]]
    df = stream(spark, str(tmp_path / "in"), batches, "user_id bigint, ts timestamp")
    query = signals.profile_triggers_stream(df).writeStream.format("memory").queryName("idle").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # One value, one timer and what lists it for each user: all twenty at first, two at the end.
    assert max(kept) >= 20 and kept[-1] <= max(kept) // 5
    fired = [(r.user_id, r.signals) for r in spark.table("idle").collect()]
    assert fired.count((3, 1)) == 2 and len(fired) == 20 + 4


def test_memories_join_their_question_within_the_limit(spark, tmp_path):
    def turn(request, hours):
        at = NOW + timedelta(hours=hours)
        done = [event(request, 0, "delta", text="It has three rooms and a large balcony, a kitchen, two bathrooms and a view over the whole bay. [S1]"), event(request, 1, "done", stop_reason="end_turn")]
        return [(*e[:2], at + timedelta(seconds=e[1]), *e[3:]) for e in done]

    ahead = (*event("z", 0, "delta", text="!")[:2], NOW + timedelta(days=9), *event("z", 0, "delta", text="!")[3:])
    df = stream(spark, str(tmp_path / "in"), [turn("a", 0), turn("b", 30), turn("c", 31), [ahead]], EVENT)
    asked = [("a", 1, "s", "u", "How many rooms does the house have?", NOW), ("b", 2, "s", "u", "How many rooms has the flat?", NOW + timedelta(hours=1)),
             ("c", 3, "s", "u", "How many rooms has the villa?", NOW + timedelta(hours=30, minutes=30))]
    far = [("z", 9, "s", "u", "Is it far away from the sea side?", NOW + timedelta(days=9))]
    q = stream(spark, str(tmp_path / "q"), [asked[:2], asked[2:], far], "request_id string, message_id bigint, session_id string, user_id string, question string, created_at timestamp")
    out = run.run_to_table(turns.memory_stream(df, q, dim=8), "memory").collect()
    # The answer to b came 29 hours after its question.
    assert sorted(r.message_id for r in out) == [1, 3] and all(len(r.embedding) == 8 for r in out)


def test_late_requests_are_not_counted(spark, tmp_path):
    base = [(1, NOW + timedelta(seconds=s)) for s in range(5)]
    # Rows are dropped as late from the second batch after the one that moved the time.
    batches = [base, *[[(2, NOW + timedelta(hours=h))] for h in (2, 3)], [(1, NOW + timedelta(seconds=30))],
               [(2, NOW + timedelta(hours=9))]]
    df = stream(spark, str(tmp_path / "in"), batches, "user_id bigint, ts timestamp")
    out = run.run_to_table(rate.over_limit_stream(df, most=3), "limits")
    assert [(r.user_id, r.requests) for r in out.collect()] == [(1, 5)]


RECORD = "doc_id string, url string, title string, markdown string, doc_type string, language string"


def test_ingest_again_changes_nothing(spark, tmp_path):
    rows = [(f"d{i}", f"http://h/{i}", None, f"# Head {i}\n\nText {i}", "article", "en") for i in range(5)]
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    ingest.stream_ingest(stream(spark, source, [rows[:3], rows[2:]], RECORD), store, buckets=4, dim=8)
    first = tables.read_chunks(spark, f"{store}/rag_chunks").drop("created_at", "updated_at").collect()
    assert len(first) == 5
    # The same input through a new checkpoint: all hashes are known.
    ingest.stream_ingest(
        spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(source), store, buckets=4, dim=8
    )
    again = tables.read_chunks(spark, f"{store}/rag_chunks").drop("created_at", "updated_at").collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert tables.read_chunks(spark, f"{store}/documents").count() == 5


def test_shared_folder_comes_from_the_session(spark):
    from corpusflow.session import settled, work_dir

    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = settled(spark.range(3).withColumn("x", F.lit(1)))
    assert df.count() == 3 and work_dir(spark) in spark.sparkContext.getCheckpointDir()


def test_a_batch_body_sees_the_shuffle_partitions_of_the_session(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = stream(spark, str(tmp_path / "in"), [[(1,)]], "a int")
        run.run_batches(df, "body", lambda batch, _: seen.append(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == ["64"]


def test_texts_are_brought_together_only_where_a_batch_repeats_a_document(spark, tmp_path, monkeypatch):
    kept, written = [], ingest.written
    monkeypatch.setattr(ingest, "written", lambda df: kept.append(1) or written(df))
    kind = "doc_id string, url string, title string, markdown string, doc_type string, language string"
    rows = [(f"d{i}", "http://h/x", "t", f"Text {i}", "article", "en") for i in range(4)]
    again = ("d1", "http://h/x", "t", "Text 9", "article", "en")
    ingest.stream_ingest(stream(spark, str(tmp_path / "in"), [rows, [rows[1], again]], kind), str(tmp_path / "store"), buckets=2, dim=4)
    texts = {r.doc_id: r.content for r in tables.read_chunks(spark, f"{tmp_path}/store/rag_chunks").collect()}
    assert kept == [1] and texts == {"d0": "Text 0", "d1": "Text 9", "d2": "Text 2", "d3": "Text 3"}


def test_a_batch_takes_what_it_wrote_besides_the_store_with_it(spark, tmp_path):
    """Disk beyond the store is that of one batch, also where a batch fails."""
    from pathlib import Path

    from corpusflow.session import work_dir

    def left():
        return {p.name for p in Path(work_dir(spark).removeprefix("file:")).glob("rows-*")}

    rows = [(f"d{i}", "http://h/x", "t", f"Text {i}", "article", "en") for i in range(6)]
    before, store = left(), str(tmp_path / "store")
    ingest.stream_ingest(stream(spark, str(tmp_path / "in"), [rows[:3], [*rows[2:], rows[4]]], RECORD), store, buckets=2, dim=4)
    assert left() == before and tables.read_chunks(spark, f"{store}/rag_chunks").count() == 6
    with pytest.raises(Exception, match="expected"):
        wrong = lambda texts, side: [[0.0]] * len(texts)
        ingest.stream_ingest(stream(spark, str(tmp_path / "bad"), [rows], RECORD), str(tmp_path / "other"), buckets=2, dim=4, encoder=wrong)
    assert left() == before
    hashes = {r.doc_id: r.source_hash for r in tables.read_chunks(spark, f"{store}/documents").collect()}
    assert len(hashes) == 6 and None not in hashes.values()


def test_a_batch_of_records_is_bounded(spark, tmp_path, monkeypatch):
    from checks import streams

    spark.range(4000).repartition(8).write.parquet(str(tmp_path / "in"))
    assert streams.files_per_batch(spark, str(tmp_path / "in"), 8) == 4
    held = sum(p.stat().st_size for p in (tmp_path / "in").glob("*.parquet"))
    monkeypatch.setattr(streams, "BATCH_BYTES", held // 3)
    assert streams.files_per_batch(spark, str(tmp_path / "in"), 8) == 2
