from __future__ import annotations

import shutil
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import load
from corpusflow.plans import ingest
from corpusflow.sources import corpus as corpus_source
from corpusflow.sources import appended, events, tables, uploads

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id string, chunk_index int, content_hash string, created_at timestamp, updated_at timestamp")


def test_a_table_equals_itself(spark):
    a = rows(spark, [("d", i, f"h{i}", T1, T1) for i in range(5)])
    assert {r.status for r in load.diff_chunks(a, a).collect()} == {"unchanged"}
    assert load.load_stats(load.diff_chunks(a, a)).first().asDict() == {
        "inserted": 0, "updated": 0, "skipped_unchanged": 5, "pruned": 0,
    }


def test_upsert_twice_is_upsert_once_and_keeps_created_at(spark):
    old = rows(spark, [("d", 0, "a", T1, T1), ("d", 1, "b", T1, T1)])
    new = rows(spark, [("d", 1, "B", T2, T2), ("d", 2, "c", T2, T2)])
    update = ["content_hash", "updated_at"]
    once = load.upsert(old, new, ["doc_id", "chunk_index"], update)
    twice = load.upsert(once, new, ["doc_id", "chunk_index"], update)
    want = [("d", 0, "a", T1, T1), ("d", 1, "B", T1, T2), ("d", 2, "c", T2, T2)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_update_to_null_is_kept_and_coalesce_is_not(spark):
    old = spark.createDataFrame([(1, "a", "x")], "id int, note string, tag string")
    new = spark.createDataFrame([(1, None, None)], "id int, note string, tag string")
    row = load.upsert(old, new, ["id"], ["tag"], coalesce_cols=["note"]).first()
    assert (row.note, row.tag) == ("a", None)


def test_prune_empties_documents_without_chunks(spark):
    stored = rows(spark, [(d, i, "h", T1, T1) for d in "abc" for i in range(3)])
    current = spark.createDataFrame([("a", 0), ("a", 1), ("b", None)], "doc_id string, chunk_index int")
    left = sorted((r.doc_id, r.chunk_index) for r in load.prune_chunks(stored, current).collect())
    assert left == [("a", 0), ("a", 1), ("c", 0), ("c", 1), ("c", 2)]


def test_first_row_of_a_batch_wins_when_inserting(spark):
    old = spark.createDataFrame([(1, "a", 1)], "id int, v string, t int")
    new = spark.createDataFrame([(1, "z", 1), (2, "late", 9), (2, "first", 3)], "id int, v string, t int")
    assert sorted(map(tuple, load.insert_ignore(old, new, ["id"], ["t"]).collect())) == [(1, "a", 1), (2, "first", 3)]


def test_unknown_cascade_is_refused():
    with pytest.raises(ValueError):
        load.delete_cascade({}, "nothing", None)


def chunk_rows(spark, data):
    return spark.createDataFrame(
        [(d, i, c, T1) for d, i, c in data], "doc_id string, chunk_index int, content_hash string, created_at timestamp"
    )


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_merge_appends_to_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = [f"doc{i}" for i in range(40)]
    tables.write_chunks(chunk_rows(spark, [(d, i, f"{d}-{i}") for d in docs for i in range(3)]), path, buckets=16)
    before = files_of(path)
    new = chunk_rows(spark, [("doc3", 0, "changed")])
    loaded = spark.createDataFrame([("doc3", 0), ("doc3", 1)], "doc_id string, chunk_index int")
    tables.merge_chunks(spark, path, new, loaded, buckets=16)
    after = files_of(path)
    replaced = {p.split("bucket=")[1].split("/")[0] for p in set(before) ^ set(after)}
    assert len(replaced) == 1 and set(before) < set(after)
    got = {(r.doc_id, r.chunk_index): r.content_hash for r in tables.read_chunks(spark, path).collect()}
    assert got[("doc3", 0)] == "changed" and got[("doc3", 1)] == "doc3-1" and ("doc3", 2) not in got
    assert len(got) == 40 * 3 - 1


def test_a_bucket_that_loses_its_last_row_is_emptied(spark, tmp_path):
    path = str(tmp_path / "store")
    tables.write_chunks(chunk_rows(spark, [("a", 0, "x"), ("b", 0, "y")]), path, buckets=64)
    gone = spark.createDataFrame([("a", None)], "doc_id string, chunk_index int")
    tables.merge_chunks(spark, path, chunk_rows(spark, []), gone, buckets=64)
    assert [r.doc_id for r in tables.read_chunks(spark, path).collect()] == ["b"]


def test_unchanged_documents_reach_neither_splitter_nor_encoder(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(batch, side):
        import numpy as np

        calls.add(len(batch))
        return np.ones((len(batch), 2))

    records = spark.createDataFrame(
        [(f"d{i}", f"http://h/{i}", None, f"Text {i}", "article", "en") for i in range(6)],
        "doc_id string, url string, title string, markdown string, doc_type string, language string",
    )
    nothing = spark.createDataFrame([], "doc_id string, chunk_index int, content_hash string, source_hash string")
    first = ingest.plan_load(records, nothing, nothing, F.current_timestamp(), dim=2, encoder=counting)
    chunks = first.changed_chunks.collect()
    assert calls.value == 6 == len(chunks)
    stored = spark.createDataFrame(
        [(c.doc_id, c.chunk_index, c.content_hash) for c in chunks], "doc_id string, chunk_index int, content_hash string"
    )
    known = first.documents.select("doc_id", "source_hash")
    edited = records.withColumn("markdown", F.when(F.col("doc_id") == "d4", "New text").otherwise(F.col("markdown")))
    second = ingest.plan_load(edited, known, stored, F.current_timestamp(), dim=2, encoder=counting)
    assert [c.doc_id for c in second.changed_chunks.collect()] == ["d4"] and calls.value == 7
    assert second.stats.first().asDict() == {"inserted": 0, "updated": 1, "skipped_unchanged": 0, "pruned": 0}


def test_broken_corpus_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id": "a", "url": "u", "markdown": "x"}\nnot json\n')
    got = corpus_source.read_corpus(spark, str(tmp_path / "c.jsonl")).cache()
    assert [r.doc_id for r in got.filter("_corrupt_record IS NULL").collect()] == ["a"]
    assert [r._corrupt_record for r in got.filter("_corrupt_record IS NOT NULL").collect()] == ["not json"]


def test_event_lines_skip_noise(spark, tmp_path):
    (tmp_path / "e.txt").write_text(': ping\n\ndata:\ndata: {bad\nevent: x\n  data: {"type": "delta", "text": "hi"}  \n')
    rows_ = events.read_event_lines(spark, str(tmp_path / "e.txt")).collect()
    assert [(r.event.type, r.event.text) for r in rows_] == [("delta", "hi")]


def test_part_files(spark, tmp_path):
    (tmp_path / "up.1.3.part").write_bytes(b"abc")
    row = uploads.read_part_files(spark, str(tmp_path)).first()
    assert (row.upload_id, row.part_index, row.total_parts, bytes(row.data)) == ("up", 1, 3, b"abc")


def test_page_without_title_uses_its_first_heading(spark):
    pages = spark.createDataFrame(
        [
            ("http://h/en/units/a", "<html><head><title> A &amp; B </title></head><body><nav>menu</nav><h1>One</h1><p>Text<br>more</p></body></html>"),
            ("http://h/ru/x", "<h1>Only <b>heading</b></h1><script>var a = '<p>no</p>'</script><ul><li>x</li></ul>"),
        ],
        "url string, html string",
    )
    a, b = corpus_source.pages_to_corpus(pages).orderBy("url").collect()
    assert (a.title, a.markdown, a.doc_type, a.language) == ("A & B", "# One\n\nText\nmore", "listing", "en")
    assert (b.title, b.markdown, b.doc_type, b.language) == ("Only heading", "# Only heading\n\n- x", "article", "ru")


def test_a_load_without_a_stored_column_keeps_it(spark, tmp_path):
    path = str(tmp_path / "store")
    stored = spark.createDataFrame(
        [(f"doc{i}", 0, f"h{i}", T1, "s1" if i % 2 else None, i) for i in range(20)],
        "doc_id string, chunk_index int, content_hash string, created_at timestamp, session_id string, page int",
    )
    tables.write_chunks(stored, path, buckets=2)
    # The new rows have no session_id and no page, but a column of their own.
    new = chunk_rows(spark, [("doc1", 0, "new"), ("doc2", 0, "new"), ("doc99", 0, "new")]).withColumn("lang", F.lit("en"))
    loaded = new.select("doc_id", "chunk_index")
    tables.merge_chunks(spark, path, new, loaded, buckets=2)
    got = {r.doc_id: r for r in tables.read_chunks(spark, path).collect()}
    assert len(got) == 21
    for i in range(20):
        row = got[f"doc{i}"]
        assert (row.session_id, row.page) == ("s1" if i % 2 else None, i)
        assert row.content_hash == ("new" if i in (1, 2) else f"h{i}")
    assert got["doc99"].session_id is None and got["doc99"].lang == "en" and got["doc5"].lang is None


def test_a_merge_that_drops_a_stored_column_is_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = chunk_rows(spark, [("a", 0, "x")])
    tables.write_chunks(rows, path, buckets=2)
    with pytest.raises(ValueError, match="content_hash"):
        tables.merge_table(spark, path, rows, lambda df: df.drop("content_hash"), rows.schema, buckets=2)
    assert tables.read_chunks(spark, path).count() == 1


def bytes_of(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_a_small_load_writes_in_proportion(spark, tmp_path):
    path = str(tmp_path / "store")
    many = spark.range(200_000).selectExpr("concat('doc', id) as doc_id", "0 as chunk_index", "sha2(cast(id as string), 256) as content_hash", "timestamp'2024-01-01' as created_at")
    tables.write_chunks(many, path, buckets=16)
    whole = bytes_of(path)
    new = many.limit(100).withColumn("content_hash", F.lit("new"))
    tables.merge_chunks(spark, path, new, new.select("doc_id", "chunk_index"), buckets=16)
    assert 0 < bytes_of(path) - whole < whole / 100
    assert tables.read_chunks(spark, path).filter("content_hash = 'new'").count() == 100
    assert tables.read_chunks(spark, path).count() == 200_000
    # The same load again changes nothing and writes nothing.
    before = bytes_of(path)
    tables.merge_chunks(spark, path, new, new.select("doc_id", "chunk_index"), buckets=16)
    assert bytes_of(path) == before


def test_loads_are_compacted_and_unfinished_ones_ignored(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    monkeypatch.setattr(appended, "MAX_LOADS", 3)
    want = {f"d{i}": "0" for i in range(30)}
    tables.write_chunks(chunk_rows(spark, [(d, 0, c) for d, c in want.items()]), path, buckets=4)
    for turn in range(6):
        gone = f"d{turn}"
        new = {f"d{(turn * 7) % 30}": f"t{turn}", f"new{turn}": "n"}
        want |= new
        want.pop(gone, None)
        new.pop(gone, None)
        rows_ = chunk_rows(spark, [(d, 0, c) for d, c in new.items()])
        loaded = rows_.select("doc_id", "chunk_index").unionByName(spark.createDataFrame([(gone, None)], "doc_id string, chunk_index int"))
        tables.merge_chunks(spark, path, rows_, loaded, buckets=4)
        assert {r.doc_id: r.content_hash for r in tables.read_chunks(spark, path).collect()} == want
    numbers, base = appended.live(spark, path)
    assert base > 0 and len(numbers) <= 4
    unfinished = Path(path) / f"load={max(numbers) + 1}" / "bucket=0"
    unfinished.mkdir(parents=True)
    shutil.copy(next(Path(path).rglob("*.parquet")), unfinished / "part.parquet")
    assert {r.doc_id: r.content_hash for r in tables.read_chunks(spark, path).collect()} == want
    appended.drop_superseded(spark, path)
    assert {r.doc_id: r.content_hash for r in tables.read_chunks(spark, path).collect()} == want


def test_a_lookup_opens_the_partitions_of_the_asked_documents(spark, tmp_path):
    path = str(tmp_path / "store")
    tables.write_chunks(chunk_rows(spark, [(f"d{i}", k, "h") for i in range(50) for k in range(2)]), path, buckets=16)
    asked = spark.createDataFrame([("d3",), ("d3",), ("none",)], "doc_id string")
    found = tables.lookup(spark, path, asked, buckets=16)
    assert [(r.doc_id, r.chunk_index) for r in found.orderBy("chunk_index").collect()] == [("d3", 0), ("d3", 1)]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters")[1][:400]


def test_a_load_where_all_documents_moved_shuffles_no_text(spark):
    records = spark.createDataFrame(
        [(f"d{i}", f"http://h/{i}", None, f"Text {i}", "article", "en") for i in range(6)],
        "doc_id string, url string, title string, markdown string, doc_type string, language string",
    )
    nothing = spark.createDataFrame([], "doc_id string, chunk_index int, content_hash string, source_hash string")
    first = ingest.plan_load(records, nothing, nothing, F.current_timestamp(), dim=2)
    assert "Exchange" not in first.changed_chunks._jdf.queryExecution().executedPlan().toString()
    assert first.changed_chunks.count() == 6


def test_a_merge_replaces_rows_that_differ_in_a_moved_null_or_a_microsecond(spark, tmp_path):
    path, kind = str(tmp_path / "store"), "doc_id string, chunk_index int, m struct<a: int, b: int>, updated_at timestamp"
    a, b = datetime(2024, 1, 1, 0, 0, 0, 1), datetime(2024, 1, 1, 0, 0, 0, 2)
    tables.write_chunks(spark.createDataFrame([("x", 0, (1, None), a), ("y", 0, (1, 2), a), ("z", 0, (1, 2), a)], kind), path, buckets=2)
    new = spark.createDataFrame([("x", 0, (None, 1), a), ("y", 0, (1, 2), b), ("z", 0, (1, 2), a)], kind)
    tables.merge_chunks(spark, path, new, new.select("doc_id", "chunk_index"), buckets=2)
    assert sorted(map(tuple, tables.read_chunks(spark, path).collect())) == sorted(map(tuple, new.collect()))
    assert spark.read.parquet(f"{path}/load=1").count() == 2
    assert sorted(r.updated_at for r in tables.read_chunks(spark, path, columns=["updated_at"]).collect()) == [a, a, b]


def test_a_load_that_only_adds_keys_makes_no_new_base_due(spark, tmp_path, monkeypatch):
    """Such a load is read with the base; what later changes, removes or adds its keys again still counts."""
    path = str(tmp_path / "store")
    monkeypatch.setattr(appended, "WORTH", 0)
    tables.write_chunks(chunk_rows(spark, [(f"d{i}", k, "0") for i in range(40) for k in range(2)]), path, buckets=4)
    more = chunk_rows(spark, [(f"e{i}", k, "0") for i in range(40) for k in range(2)])
    tables.merge_chunks(spark, path, more, more.select("doc_id", "chunk_index"), buckets=4)
    assert appended.live(spark, path) == ([0, 1], 0)
    plan = tables.read_chunks(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    # One changed, one pruned to nothing, then added again by a load that finds none of its keys.
    monkeypatch.setattr(appended, "WORTH", 1 << 30)
    new = chunk_rows(spark, [("d1", 0, "1"), ("e1", 0, "1"), ("e1", 1, "0")])
    gone = spark.createDataFrame([("d1", 0), ("e1", 0), ("e1", 1), ("e2", None)], "doc_id string, chunk_index int")
    tables.merge_chunks(spark, path, new, gone, buckets=4)
    again = chunk_rows(spark, [("e2", 0, "2")])
    tables.merge_chunks(spark, path, again, again.select("doc_id", "chunk_index"), buckets=4)
    want = {(f"{n}{i}", k): "0" for n in "de" for i in range(40) for k in range(2)}
    want |= {("d1", 0): "1", ("e1", 0): "1", ("e2", 0): "2"}
    del want["d1", 1], want["e2", 1]
    got = tables.read_chunks(spark, path).collect()
    assert {(r.doc_id, r.chunk_index): r.content_hash for r in got} == want and len(got) == len(want)
