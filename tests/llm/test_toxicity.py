from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusflow.llm import toxicity
from corpusflow.llm.queries_toxicity import op7
from tests.llm.cases import SCHEMA, awkward, prose, table

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, rng, n=400):
    rows, labels = [], []
    for k in range(100, 100 + n):
        bad = rng.random() < 0.2
        words = prose(rng, rng.randint(5, 120)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "IDIOTS"]))
        rows.append((k, " ".join(words), None, None, None, 0, "", "", ""))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_held_out_documents(spark):
    rng = random.Random(1)
    rows, labels = labelled(spark, rng)
    docs = table(spark, rows + awkward(rng))
    extra = [(1, 1, None), (None, 1, 1), (100, 1, labels[0][2]), (999_999, 0, 1)]
    model = toxicity.train(docs, spark.createDataFrame(labels + extra, LABELS))
    got = {
        r["doc_id"]: r["s"]
        for r in docs.filter("doc_id >= 100").select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()
    }
    held = [(got[k], t) for k, _, t in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 40 and all((s >= 0.5) == bool(t) for s, t in held)
    scores = [r[0] for r in docs.select(toxicity.score(model, F.col("text"))).collect()]
    assert all(0 <= s <= 1 for s in scores)
    clean = toxicity.keep_clean(docs, spark.createDataFrame(labels, LABELS))
    assert clean.columns == docs.columns
    assert clean.filter("doc_id < 100 OR doc_id IS NULL").count() == len(awkward(random.Random(1)))


def test_held_out_labels_are_never_learnt(spark):
    rows, labels = labelled(spark, random.Random(2), 200)
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    docs = table(spark, rows)
    one, two = (toxicity.train(docs, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert np.array_equal(one.place, two.place) and np.array_equal(one.weights, two.weights)


def test_long_texts_count_whole():
    text = "ab cd " * 40_000
    assert len(toxicity.gram_ids(text + "zzzzzz")) == len(text) * 3 + 6 * 3 - (3 + 4 + 5)


def test_without_labels_or_documents(spark):
    docs = table(spark, awkward(random.Random(3)))
    none = spark.createDataFrame([], LABELS)
    assert toxicity.keep_clean(docs, none).count() == docs.count()
    only = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)
    assert toxicity.keep_clean(docs, only).count() == docs.count()
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.keep_clean(empty, none).count() == 0


def test_accuracy_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = op7(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    right = got.filter("predicted = toxic").count()
    assert right / got.count() > 0.95
