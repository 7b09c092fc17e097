from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import encode, filters, vector


def brute(queries, items, k, allowed=None):
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    i = items / np.linalg.norm(items, axis=1, keepdims=True)
    sims = np.round(q @ i.T, 6)
    if allowed is not None:
        sims = np.where(allowed, sims, -np.inf)
    out = {}
    for row in range(len(q)):
        order = sorted(range(len(i)), key=lambda c: (-sims[row, c], c))
        out[row] = [c for c in order if np.isfinite(sims[row, c])][:k]
    return out


def table(spark, vectors, name, extra=None):
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>")


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    items = rng.normal(size=(400, 16)).astype(np.float32)
    # A third of all items are copies of one vector: equal scores everywhere.
    items[100:233] = items[7]
    queries = rng.normal(size=(60, 16)).astype(np.float32)
    queries[0] = items[7]
    return queries, items


def test_scan_equals_brute_force(spark, vectors):
    q, i = vectors
    got = as_lists(vector.knn(table(spark, q, "query_id"), table(spark, i, "item_id"), 12))
    assert got == brute(q, i, 12)


def test_many_queries_take_the_grid_and_agree(spark, vectors, monkeypatch):
    q, i = vectors
    monkeypatch.setattr(vector, "QUERY_BLOCK_ROWS", 10)
    monkeypatch.setattr(vector, "GROUP_ITEMS", 50)
    monkeypatch.setattr(vector, "GROUP_QUERIES", 7)
    got = as_lists(vector.knn(table(spark, q, "query_id"), table(spark, i, "item_id"), 12))
    assert got == brute(q, i, 12)


def test_k_per_query(spark, vectors):
    q, i = vectors
    asked = table(spark, q, "query_id").withColumn("wide", (F.col("query_id") % 5).cast("int"))
    got = as_lists(vector.knn(asked, table(spark, i, "item_id"), "wide"))
    want = {row: hits[: row % 5] for row, hits in brute(q, i, 5).items() if row % 5}
    assert got == want


def test_filters_apply_before_the_cut(spark, vectors):
    q, i = vectors
    items = table(spark, i, "item_id").withColumn(
        "metadata",
        F.struct(
            F.when(F.col("item_id") % 2 == 0, "en").otherwise("ru").alias("language"),
            F.lit("article").alias("doc_type"), F.lit(None).cast("string").alias("listing_type"),
            F.lit(None).cast("string").alias("property_type"),
            F.when(F.col("item_id") % 4 != 1, F.col("item_id").cast("double")).alias("price"),
            F.lit(None).cast("int").alias("bedrooms"), F.lit(None).cast("double").alias("area_sqm"),
        ),
    )
    asked = table(spark, q, "query_id").withColumn(
        "filters",
        filters.filters_struct(
            language=F.when(F.col("query_id") % 2 == 0, F.array(F.lit("en"))),
            price_min=F.when(F.col("query_id") % 3 == 0, F.lit(50)),
        ),
    )
    got = as_lists(vector.knn(asked, items, 9, filters=True))
    c = np.arange(len(i))
    allowed = np.array(
        [
            ((row % 2 != 0) | (c % 2 == 0)) & ((row % 3 != 0) | ((c % 4 != 1) & (c >= 50)))
            for row in range(len(q))
        ]
    )
    assert got == brute(q, i, 9, allowed)


def test_all_probes_are_exact_and_a_hot_cell_is_split(spark, vectors, monkeypatch):
    q, i = vectors
    monkeypatch.setattr(vector, "GROUP_ITEMS", 40)
    monkeypatch.setattr(vector, "GROUP_QUERIES", 9)
    items = table(spark, i, "item_id")
    cells = vector.train_cells(items, 6)
    approx = vector.knn_approx(table(spark, q, "query_id"), items, 10, cells=cells, probes=6)
    assert as_lists(approx) == brute(q, i, 10)


def test_recall_grows_with_probes(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    items = given.select(F.col("vec_id").alias("item_id"), "embedding")
    queries = given.select(F.col("vec_id").alias("query_id"), "embedding")
    cells = vector.train_cells(items, 10)
    rows = {r.probes: r.recall for r in vector.recall_by_probes(queries, items, 10, cells, [1, 8, 10]).collect()}
    assert rows[1] < rows[8] <= rows[10] == 1.0
    # These vectors hardly cluster, so most cells have to be looked at.
    assert rows[8] >= 0.9


def test_recall_by_probes_is_that_of_the_approximate_search(spark, monkeypatch):
    """Measured by one exact search, with the figures the approximate searches have."""
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    items = given.select(F.col("vec_id").alias("item_id"), "embedding")
    queries = given.select(F.col("vec_id").alias("query_id"), "embedding")
    cells = vector.train_cells(items, 10)
    exact = vector.knn(queries, items, 10)
    want = {n: tuple(vector.ann_recall(exact, vector.knn_approx(queries, items, 10, cells=cells, probes=n)).first()) for n in (1, 3, 10)}
    monkeypatch.setattr(vector, "knn_approx", None)
    got = vector.recall_by_probes(queries, items, 10, cells, [1, 3, 10]).collect()
    assert {r.probes: (r.recall, r.pairs) for r in got} == want


def test_empty_sides(spark, vectors):
    q, i = vectors
    none = table(spark, i, "item_id").filter("false")
    assert vector.knn(table(spark, q, "query_id"), none, 3).count() == 0
    assert vector.knn(table(spark, q, "query_id").filter("false"), table(spark, i, "item_id"), 3).count() == 0


def test_rows_without_a_vector_do_not_take_part(spark, vectors):
    q, i = vectors
    items = table(spark, i, "item_id").withColumn("embedding", F.when(F.col("item_id") != 7, F.col("embedding")))
    hits = vector.knn(table(spark, q, "query_id"), items, 400).filter("query_id = 0").collect()
    assert len(hits) == 399 and 7 not in {h.item_id for h in hits}


def test_pluggable_encoder_is_checked(spark):
    texts = spark.createDataFrame([("a",), (" ",), (None,)], "content string")
    seen = lambda batch, side: np.array([[len(t), 1.0 if side == "query" else 0.0] for t in batch])
    rows = encode.embed(texts, dim=2, encoder=seen, side="query").collect()
    assert [list(r.embedding) for r in rows] == [[1.0, 1.0], [1.0, 1.0], [1.0, 1.0]]
    with pytest.raises(Exception, match="expected"):
        encode.embed(texts, dim=3, encoder=seen).collect()


def test_builtin_encoder_sides_and_empty_text(spark):
    texts = spark.createDataFrame([("a a a b",), ("",), (None,)], "content string")
    doc, empty, missing = encode.embed(texts, dim=64).collect()
    query = encode.embed(texts, dim=64, side="query").first()
    assert np.isclose(np.linalg.norm(doc.embedding), 1) and sum(v != 0 for v in query.embedding) == 2
    assert len(set(v for v in query.embedding if v)) == 1 and len(set(v for v in doc.embedding if v)) == 2
    assert not any(empty.embedding) and len(empty.embedding) == 64


def test_dimension_check(spark, vectors):
    q, _ = vectors
    df = table(spark, q, "query_id")
    assert encode.check_dim(df, 16).count() == len(q) and encode.wrong_dimension(df, 16).count() == 0
    with pytest.raises(Exception, match="expected 8"):
        encode.check_dim(df, 8).collect()


def test_running_floor_keeps_ties_and_masked_items_out():
    """What lies below the kth best so far is skipped; equal similarities still fall to the smaller id, in any order of arrival."""
    rng = np.random.default_rng(11)
    items = rng.normal(size=(300, 8))
    items[50:120] = items[3]
    items[200:260] = -items[3]
    queries = np.vstack([items[3], rng.normal(size=(4, 8))])
    ids = rng.permutation(300)
    block = vector.QueryBlock(np.arange(5), vector.unit_rows(pa.array(queries.tolist())), np.array([7, 1, 40, 300, 0]), [{}], np.zeros(5, dtype=np.int64))
    best = vector._Best(block)
    for start in range(0, 300, 37):
        part = ids[start : start + 37]
        best.add(pa.table({"item_id": part, "item_vector": pa.array(items[part].tolist())}), filters.PairRules())
    want = brute(queries, items, 300)
    for row, k in enumerate(block.k):
        assert best.ids[best.rows == row].tolist() == want[row][:k]
    full = block.k > 0
    assert [best.floor[r] for r in np.flatnonzero(full)] == [best.sims[best.rows == r][-1] for r in np.flatnonzero(full)]


def test_kept_rows_are_sorted_a_few_times_not_once_per_product(monkeypatch):
    """Similarities closer than single precision tells apart keep their order, and what is kept is not sorted with each product."""
    rng = np.random.default_rng(2)
    queries, items = rng.normal(size=(2000, 24)), rng.normal(size=(12_000, 24))
    items[5000:5040] = queries[3] + rng.normal(scale=1e-4, size=(40, 24))
    items[7000:7600] = items[11]
    block = vector.QueryBlock(np.arange(2000), vector.unit_rows(pa.array(queries.tolist())), np.full(2000, 10), [{}], np.zeros(2000, dtype=np.int64))
    best, sort, rows = vector._Best(block), np.lexsort, []
    monkeypatch.setattr(vector.np, "lexsort", lambda keys: rows.append(len(keys[0])) or sort(keys))
    best.add(pa.table({"item_id": np.arange(12_000), "item_vector": pa.array(items.tolist())}), filters.PairRules())
    assert sum(rows) < 2000 * 10 * 20
    sims = np.round(block.unit @ vector.unit_rows(pa.array(items.tolist())).T, 6)
    want = [sorted(np.argpartition(-s, 700)[:700], key=lambda c, s=s: (-s[c], c))[:10] for s in sims]
    assert best.ids.reshape(2000, 10).tolist() == [[int(c) for c in w] for w in want]


def test_blocks_are_as_square_as_they_can_be(spark, monkeypatch):
    """A vector is copied once per block of the other side: neither side may meet very many."""
    queries, items = (
        spark.range(60_000).select(F.col("id").alias(f"{n}_id"), F.expr("array(1f, float(id))").alias(f"{n}_vector"), F.lit(0).alias("cell"))
        for n in ("query", "item")
    )
    met = {}
    kept = vector._square_blocks
    monkeypatch.setattr(vector, "_square_blocks", lambda q, i: met.setdefault("blocks", kept(q, i)))
    monkeypatch.setattr(vector, "GROUPS_PER_CORE", 1)
    vector._grid(queries, items, 3, filters.PairRules(), few_cells=True)
    row, groups = met["blocks"].first(), spark.sparkContext.defaultParallelism
    assert max(row.item_parts, row.query_parts) <= groups**0.5 + 2
    monkeypatch.setattr(vector, "GROUP_NUMBERS", 2 * 5000)
    assert tuple(kept(queries, items).first()) == (0, 12, 12)


def test_own_session_mask_compares_columns(monkeypatch):
    """Thousands of sessions are one comparison: no scan of the items per rule."""
    rules = [{"session_id": s} for s in ("a", "b", None, "unknown")]
    items = pa.table({"session_id": pa.array(["a", None, "b", "a"])})
    monkeypatch.setattr(filters.pc, "equal", lambda *_: pytest.fail("one scan per rule"))
    got = filters.PairRules(other_session=True).masks(rules, items)
    assert got.tolist() == [[False, True, True, False], [True, True, False, True], [True] * 4, [True] * 4]


def test_product_of_a_task_stays_small():
    assert vector.PRODUCT_CELLS * 8 <= 8 << 20
