from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import chunking, corpus


def brute_units(text, most):
    out = []
    for section in re.split(r"(?m)(?=^#{1,6}\s+.)", text):
        for para in filter(None, (p.strip() for p in re.split(r"\n{2,}", section.strip()))):
            if len(para) <= most:
                out.append(para)
                continue
            held = None
            for sentence in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])", para):
                if len(sentence) > most:
                    out += ([held] if held else []) + [sentence[i : i + most] for i in range(0, len(sentence), most)]
                    held = None
                elif held is None:
                    held = sentence
                elif len(held) + 1 + len(sentence) <= most:
                    held += " " + sentence
                else:
                    out.append(held)
                    held = sentence
            if held:
                out.append(held)
    return out


def brute_lead(previous, overlap):
    if len(previous) <= overlap:
        return previous
    tail = previous[-overlap:]
    found = re.search(r"[.!?]\s+(.+)$", tail, re.S) or re.search(r"\s+(\S.*)$", tail, re.S)
    return (found.group(1) if found else tail).strip()


def brute_chunks(text, most, overlap, least):
    done, held = [], None
    for unit in brute_units(text, most):
        if held is None:
            held = unit
        elif len(held) + 2 + len(unit) <= most:
            held += "\n\n" + unit
        else:
            done.append(held.strip())
            led = brute_lead(done[-1], overlap) + "\n\n" + unit if overlap else unit
            held = led if len(led) <= most else unit
    if held is not None:
        done.append(held.strip())
    if len(done) > 1 and len(done[-1]) < least and len(done[-2]) + 2 + len(done[-1]) <= most:
        done[-2:] = [done[-2] + "\n\n" + done[-1]]
    return done


def random_text(rng):
    words = ["alpha", "Beta", "gamma", "Delta", "x" * 40, "eps"]
    out = []
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        sentences = [
            " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))).capitalize() + rng.choice(".!?")
            for _ in range(rng.randint(1, 8))
        ]
        out.append(("# " if kind < 0.2 else "") + " ".join(sentences) + ("y" * 300 if kind > 0.9 else ""))
    return "\n\n".join(out)


@pytest.mark.parametrize("most,overlap,least", [(120, 30, 25), (200, 60, 80), (120, 0, 0)])
def test_chunks_equal_a_plain_walk(spark, most, overlap, least):
    rng = random.Random(most + overlap)
    texts = [random_text(rng) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    got = {
        r.i: r.chunks
        for r in rows.select("i", chunking.chunk_text(F.col("body"), most, overlap, least).alias("chunks")).collect()
    }
    for i, text in enumerate(texts):
        assert got[i] == brute_chunks(text, most, overlap, least)
        assert all(len(c) <= most for c in got[i])


def test_no_text_no_chunk(one):
    assert one(chunking.chunk_text, "") == []


def test_listing_is_one_chunk_with_its_facts(spark):
    rows = spark.createDataFrame(
        [
            ("a", "http://h/1", "Flat, Baku", "Price $450,000\n\n" + "word " * 500, "listing", "en"),
            ("b", "http://h/2", "Only a title", "", "listing", None),
            ("c", "http://h/3", None, "", None, None),
        ],
        "doc_id string, url string, title string, markdown string, doc_type string, language string",
    )
    chunks = corpus.chunk_documents(corpus.prepare_documents(rows)).orderBy("doc_id").collect()
    assert [(c.doc_id, c.chunk_index) for c in chunks] == [("a", 0), ("b", 0)]
    assert chunks[0].metadata.price == 450000.0 and chunks[0].metadata.location == "Baku"
    assert chunks[1].content == "Only a title" and chunks[1].metadata.language == "en"


def test_pages_keep_a_running_index_and_a_limit_per_page(spark):
    long_page = "\n\n".join(f"Paragraph {i} " + "z" * 90 for i in range(60))
    pages = spark.createDataFrame(
        [("d", 1, "one"), ("d", 2, long_page), ("d", 3, "three"), ("e", 1, "")], "doc_id string, page int, text string"
    )
    chunks = corpus.chunk_pages(pages, max_per_page=4, max_chars=120, overlap=0, min_chars=0)
    rows = chunks.orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == [0, 1, 2, 3, 4, 5]
    assert [r.page for r in rows] == [1, 2, 2, 2, 2, 3]
    limits = {r.doc_id: r.reason for r in corpus.document_limits(pages).collect()}
    assert limits == {"d": None, "e": "no_text"}


def test_chunks_beyond_the_limit_per_page_are_counted(spark):
    long_page = "\n\n".join(f"Paragraph {i} " + "z" * 90 for i in range(60))
    pages = spark.createDataFrame(
        [("d", 1, "one"), ("d", 2, long_page), ("d", 3, long_page), ("e", 1, "short"), ("f", 1, "")],
        "doc_id string, page int, text string",
    )
    limits = {"max_chars": 120, "overlap": 0, "min_chars": 0}
    dropped = {r.doc_id: r.dropped_chunks for r in corpus.dropped_chunks(pages, 4, **limits).collect()}
    assert dropped == {"d": 112, "e": 0}
    kept = corpus.chunk_pages(pages, 4, **limits).filter("doc_id = 'd'").count()
    assert kept + dropped["d"] == corpus.chunk_pages(pages, 100, **limits).filter("doc_id = 'd'").count()


def test_a_very_long_url_word_is_shown_whole(spark):
    word = "a" * 1_000_100
    df = spark.createDataFrame([(f"https://h.example/{word}-b",)], "url string")
    assert corpus.url_parts(df).first()["pretty"] == "A" + word[1:] + " B"


def test_fragments_join_in_order(spark):
    fragments = spark.createDataFrame(
        [("d", 1, 2, "world"), ("d", 1, 0, "hello"), ("d", 1, 1, ""), ("d", 2, 0, "")],
        "doc_id string, page int, position int, str string",
    )
    got = {r.page: r.text for r in corpus.assemble_pages(fragments).collect()}
    assert got == {1: "hello world", 2: ""}


@pytest.mark.parametrize("blank", [" ", " "])
def test_the_lead_starts_after_a_sentence_whatever_the_blank(one, blank):
    from corpusflow.operators.chunking import AFTER_BREAK

    assert one(lambda c: F.regexp_extract(c, AFTER_BREAK, 1), f"tail one.{blank}Next sentence") == "Next sentence"
