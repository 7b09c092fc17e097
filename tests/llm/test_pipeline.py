from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusflow.llm import decontaminate, toxicity
from tests.llm.cases import awkward, table
from tests.llm.test_mixing import plain as plain_mix
from tests.llm.test_near_dedup import plain as plain_dedup
from tests.llm.cases import SCHEMA, awkward, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What goes in and out of every stage, the given documents with awkward ones among them."""
    folder = tmp_path_factory.mktemp("pipeline")
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = table(spark, awkward(random.Random(1))).select("doc_id", "text", "lang", "source", "n_chars")
    docs = given.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        odd.withColumn("doc_id", F.col("doc_id") + 100_000)
    )
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_are_the_five(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mixing", "token_files"]
    assert all(after.columns == before.columns for before, after in staged[:4])


def test_toxicity(spark, staged):
    before, after = staged[0]
    model = toxicity.train(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert sorted(rows(after), key=str) == sorted((r for r in rows(before) if model.score(r[1]) < 0.5), key=str)


def test_near_dedup(staged):
    before, after = (sorted(set(rows(x)), key=str) for x in staged[1])
    given = [(r[0], r[1]) for r in before]
    plain = plain_dedup(given, 5, 80)
    want = {r for r, p in zip(before, plain, strict=True) if p[3] or (r[0] is None and p[2] is None)}
    assert set(after) == want and staged[1][1].count() == len(after)


def test_decontaminate(spark, staged):
    before, after = staged[2]
    items = [decontaminate.normalised(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    gone = set(rows(before)) - set(rows(after))
    holds = [r for r in rows(before) if any(i in decontaminate.normalised(r[1]) for i in items)]
    assert set(holds) <= gone
    for r in gone - set(holds):  # near matches only
        flat = decontaminate.normalised(r[1])
        assert any(decontaminate.best_match(i, flat, decontaminate.budget(len(i))) for i in items)


def test_mixing(staged):
    before, after = (rows(x) for x in staged[3])
    want = []
    for r, (_, size, _, _, taken) in zip(before, plain_mix(before), strict=True):
        want += [r] * (taken // size if size else 1)
    assert sorted(after, key=str) == sorted(want, key=str)


def test_token_files(staged):
    before, after = (rows(x) for x in staged[4])
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in before:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    after.sort(key=lambda r: r[1])
    assert sorted(((r[0], r[2], r[3]) for r in after), key=str) == sorted(want, key=str)
    assert [r[1] for r in after] == [sum(x[2] for x in after[:k]) for k in range(len(after))]
    ids = [r[0] for r in after]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_run_chains_the_stages(spark, staged):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_an_empty_table_passes_through(spark):
    docs = spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0
        docs = out
