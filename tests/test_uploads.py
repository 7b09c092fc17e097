from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from corpusflow.operators import lexical
from corpusflow.operators.encode import embed
from corpusflow.plans import answer, ingest

PARTS = "upload_id string, user_id string, session_id string, part_index int, total_parts int, filename string, data binary, created_at timestamp"
S1, S2 = "00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000b"


def name(n):
    return f"11111111-1111-1111-1111-{n:012d}"


def part(n, user, session, at, total, filename, data, hour=1):
    return (name(n), user, session, at, total, filename, data, dt.datetime(2024, 1, 1, hour))


def sessions_of(spark):
    return spark.createDataFrame([(S1, "ann"), (S2, "bob")], "session_id string, user_id string")


FILES = [
    part(1, "ann", S1, 0, 2, "plan.pdf", b"%PDF-1\x0cthe harbour crane costs a lot\x0cseco"),
    part(1, "ann", S1, 1, 2, "plan.pdf", b"nd page about gardens"),
    part(2, "bob", S2, 0, 1, "plan.pdf", b"%PDF-\x0cthe harbour ferry is late"),
    part(3, "ann", S2, 0, 1, "stolen.pdf", b"%PDF-\x0cnot my session"),
    part(4, "bob", S2, 0, 2, "half.pdf", b"%PDF-\x0conly half"),
    part(5, "bob", S2, 0, 1, "blank.pdf", b"%PDF-\x0c  \x0c "),
    part(6, "bob", S2, 0, 1, "old.pdf", b"%PDF-\x0cdraft wording", 1),
    part(7, "bob", S2, 0, 1, "old.pdf", b"%PDF-\x0cfinal wording", 2),
    part(8, None, None, 0, 1, "nobody.pdf", b"%PDF-\x0cno session"),
]


def test_parts_become_chunks_with_page_and_file_name(spark):
    got = ingest.index_uploads(spark.createDataFrame(FILES, PARTS), sessions_of(spark))
    chunks = {(r.session_id, r.filename, r.page): r.content for r in got.chunks.select("session_id", "metadata.filename", "metadata.page", "content").collect()}
    assert chunks == {
        (S1, "plan.pdf", 1): "the harbour crane costs a lot",
        (S1, "plan.pdf", 2): "second page about gardens",
        (S2, "plan.pdf", 1): "the harbour ferry is late",
        (S2, "old.pdf", 1): "final wording",
    }
    documents = {(r.session_id, r.title): (r.total_pages, r.doc_type, r.size_kb) for r in got.documents.collect()}
    assert documents == {(S1, "plan.pdf"): (2, "upload", 1), (S2, "plan.pdf"): (1, "upload", 1), (S2, "old.pdf"): (1, "upload", 1)}
    reasons = {r.upload_id: r.reason for r in got.rejected.collect()}
    assert {k: v for k, v in reasons.items() if k != name(8)} == {name(3): "not_owner", name(4): "incomplete", name(5): "no_text", name(6): "superseded"}


def test_the_same_file_in_the_same_session_keeps_its_ids(spark):
    first = ingest.index_uploads(spark.createDataFrame(FILES[:2], PARTS), sessions_of(spark)).chunks
    again = [part(9, "ann", S1, 0, 1, "plan.pdf", b"%PDF-\x0cnew words\x0cmore", 3)]
    second = ingest.index_uploads(spark.createDataFrame(again, PARTS), sessions_of(spark)).chunks
    assert {r.chunk_id for r in first.collect()} == {r.chunk_id for r in second.collect()}


def test_no_parts(spark):
    got = ingest.index_uploads(spark.createDataFrame([], PARTS), sessions_of(spark))
    assert got.documents.count() == got.chunks.count() == got.rejected.count() == 0


def test_only_the_owner_finds_an_upload(spark):
    """Questions over the public corpus and the uploads together."""
    public = spark.createDataFrame([(1, "d1", "http://a/1", 0, "a public harbour guide", None)], "chunk_id long, doc_id string, url string, chunk_index int, content string, session_id string")
    facts = F.struct(F.lit("article").alias("doc_type"), F.lit("en").alias("language"))
    public = embed(lexical.with_tokens(public.withColumn("metadata", facts)), "content")
    sessions = sessions_of(spark)
    mine = ingest.index_uploads(spark.createDataFrame(FILES, PARTS), sessions).chunks
    chunks = public.unionByName(mine, allowMissingColumns=True)
    asked = spark.createDataFrame([(1, "harbour", "ann", 9, 9), (2, "harbour", "bob", 9, 9), (3, "harbour", None, 9, 9)], "query_id long, text string, user_id string, top_k int, candidate_k int")
    hits = answer.retrieve(asked, chunks, sessions).filter("lexical_score > 0")
    got = {(r.query_id, r.content) for r in hits.collect()}
    guide = "a public harbour guide"
    assert got == {(1, guide), (2, guide), (3, guide), (1, "the harbour crane costs a lot"), (2, "the harbour ferry is late")}


def test_a_first_part_shorter_than_the_head(spark):
    files = [
        part(1, "ann", S1, 0, 3, "tiny.pdf", b"%PD"),
        part(1, "ann", S1, 1, 3, "tiny.pdf", b"F"),
        part(1, "ann", S1, 2, 3, "tiny.pdf", b"-\x0ctiny"),
        part(2, "ann", S1, 0, 2, "text.pdf", b"%PD"),
        part(2, "ann", S1, 1, 2, "text.pdf", b"%PDF-\x0cno head"),
    ]
    got = ingest.index_uploads(spark.createDataFrame(files, PARTS), sessions_of(spark))
    assert [r.content for r in got.chunks.collect()] == ["tiny"]
    assert [(r.upload_id, r.reason) for r in got.rejected.collect()] == [(name(2), "not_pdf")]
