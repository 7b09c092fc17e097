from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import fusion, index, lexical, vector
from corpusflow.operators.filters import filters_struct
from corpusflow.session import written
from corpusflow.sources import appended

CHUNK = "chunk_id long, content string, embedding array<float>, metadata struct<doc_type:string,language:string,price:double,listing_type:string,property_type:string,bedrooms:int,area_sqm:double>, session_id string, owner string"


def chunks_of(spark, rng, ids, version=0):
    words = [f"w{i}" for i in range(40)]
    centres = np.random.default_rng(1).normal(size=(6, 16)) * 3
    rows = []
    for i in ids:
        v = centres[(i + version) % 6] + np.random.default_rng(i * 7 + version).normal(size=16)
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 30)))
        owner = f"u{i % 3}" if i % 4 == 0 else None
        rows.append((i, text, [float(x) for x in v / np.linalg.norm(v)], ("article" if i % 2 else "page", "en", float(i), None, None, 1, 2.0), "s" if owner else None, owner))
    return lexical.with_tokens(spark.createDataFrame(rows, CHUNK))


def questions_of(spark, chunks):
    picked = chunks.filter("chunk_id % 9 = 0")
    text = F.array_join(F.slice("tokens", 1, 2), " ")
    filters = filters_struct(doc_type=F.when(F.col("chunk_id") % 2 == 0, F.array(F.lit("article"))))
    return picked.select(F.col("chunk_id").alias("query_id"), text.alias("text"), "embedding", F.concat(F.lit("u"), F.col("chunk_id") % 3).alias("user_id"), filters.alias("filters"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """An index built over an earlier state and brought up to date by one load."""
    path = str(tmp_path_factory.mktemp("index") / "i")
    rng = random.Random(4)
    now = chunks_of(spark, rng, range(300)).cache()
    stale = chunks_of(spark, rng, range(0, 300, 5), version=3)
    gone = chunks_of(spark, rng, range(1000, 1040))
    kept = now.filter("chunk_id % 5 <> 0 AND chunk_id < 280")
    cells = vector.train_cells(now.withColumnRenamed("chunk_id", "item_id"), 6)
    before = kept.unionByName(stale.filter("chunk_id < 280")).unionByName(gone)
    index.build_cells(before, path, cells)
    index.build_postings_store(before, path, parts=8)
    old, new = stale.filter("chunk_id < 280").unionByName(gone), now.filter("chunk_id % 5 = 0 OR chunk_id >= 280")
    index.update_cells(old, new, path)
    index.update_postings(old, new, path, parts=8)
    return path, now, cells


def test_updated_equals_built_anew(spark, stored, tmp_path):
    path, now, cells = stored
    index.build_cells(now, str(tmp_path), cells)
    index.build_postings_store(now, str(tmp_path), parts=8)
    for name, key in (("cells", index.CELL_KEY), ("postings", index.POSTING_KEY), ("terms", ["term"])):
        a, b = (appended.read(spark, f"{p}/{name}", key) for p in (path, str(tmp_path)))
        assert rows(a.select(*sorted(a.columns))) == rows(b.select(*sorted(b.columns)))


@pytest.mark.parametrize("narrow", [False, True])
def test_all_cells_equal_the_scan(spark, stored, narrow, monkeypatch):
    path, now, _ = stored
    asked = questions_of(spark, now)
    got = index.hybrid_stored(spark, path, asked, 10, probes=6, chunks=now, filters=narrow, scope=narrow, parts=8)
    want = fusion.hybrid_search(asked, now, 10, filters=narrow, scope=narrow)
    assert rows(got.select(*sorted(got.columns))) == rows(want.select(*sorted(want.columns))) and got.count() > 100
    monkeypatch.setattr(vector, "QUERY_BLOCK_ROWS", 1)
    near = index.knn_stored(spark, path, asked, 10, probes=6, filters=narrow, scope=narrow)
    exact = fusion.vector_hits(asked, now, 10, filters=narrow, scope=narrow)
    assert rows(near.select(*sorted(near.columns))) == rows(exact.select(*sorted(exact.columns)))


def partitions_opened(df):
    plan = df._jdf.queryExecution().toString()
    return [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]


def test_a_question_opens_its_cells_and_terms_only(spark, stored):
    path, now, _ = stored
    asked = questions_of(spark, now).limit(1)
    near = index.knn_stored(spark, path, asked, 5, probes=1)
    assert all("bucket#" in f for f in partitions_opened(near)) and partitions_opened(near)
    opened = near.select("item_id").count()
    assert 0 < opened <= 5
    worded = index.lexical_stored(spark, path, asked, 5, parts=8)
    assert all("bucket#" in f for f in partitions_opened(worded)) and partitions_opened(worded)


def test_recall_of_two_in_six_cells(spark, stored):
    path, now, _ = stored
    asked = now.select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = vector.knn(asked, now.withColumnRenamed("chunk_id", "item_id"), 10)
    found = vector.ann_recall(exact, index.knn_stored(spark, path, asked, 10, probes=2)).first()
    assert found["pairs"] == 3_000 and found["recall"] >= 0.9


def test_blank_and_unknown_questions_find_no_word(spark, stored):
    path, _, _ = stored
    asked = spark.createDataFrame([(1, "  "), (2, "w1 neverseen"), (3, "neverseen")], "query_id long, text string")
    assert index.lexical_stored(spark, path, asked, 5, parts=8).count() == 0


def test_what_is_asked_for_decides_what_is_merged(spark, stored, monkeypatch):
    path, now, _ = stored
    every = appended.read(spark, f"{path}/postings", index.POSTING_KEY).filter("term IN ('w1', 'w2')")
    wanted = spark.createDataFrame([("w1",), ("w2",)], "term string")
    monkeypatch.setattr(appended, "BROADCAST_ROWS", 0)
    got = appended.read(spark, f"{path}/postings", index.POSTING_KEY, within=wanted, within_fits=True)
    assert rows(got) == rows(every) and got.count() > 10
    # Loads are merged by a shuffle here, after the rows of other terms have gone.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftOuter") < plan.index("LeftSemi")


@pytest.mark.parametrize("limit", [0, 500_000])
def test_stored_words_equal_the_scan_whether_pairs_fit_or_not(spark, stored, monkeypatch, limit):
    path, now, _ = stored
    monkeypatch.setattr(index, "fits_broadcast", lambda df, *_, **__: df.count() <= limit)
    asked = questions_of(spark, now)
    got = index.lexical_stored(spark, path, asked, 10, parts=8)
    want = lexical.lexical_search(asked, now, 10)
    assert rows(got) == rows(want) and got.count() > 100


def test_mean_centres_are_plain_means_and_vectors_stay_whole(spark):
    rows = [(1, "b", [1.0, 2.0]), (2, "a", [3.0, 5.0]), (3, "b", [2.0, 0.0]), (4, None, [9.0, 9.0]), (5, "a", None)]
    items = spark.createDataFrame(rows, "chunk_id long, label string, embedding array<float>").repartition(3)
    assert index.mean_centres(items, "label").centres.tolist() == [[9.0, 9.0], [3.0, 5.0], [1.5, 1.0]]


def test_written_rows_are_read_by_column(spark):
    df = written(spark.range(5).selectExpr("id", "concat('text ', id) AS content", "array(float(id)) AS embedding"))
    assert sorted(r.id for r in df.select("id").collect()) == list(range(5))
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan.lower() and "content" not in plan.split("ReadSchema")[1]
