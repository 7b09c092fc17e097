from __future__ import annotations

import random

from corpusflow.llm import decontaminate as d
from tests.llm.cases import SCHEMA, awkward, prose, table

ITEMS = "item_id long, text string"


def least_edits(item: str, text: str) -> int:
    """Plain dynamic programme: best match of the item anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def spoil(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        k, what = rng.randrange(len(chars)), rng.randrange(3)
        if what == 0:
            chars[k] = rng.choice("xyz q")
        elif what == 1:
            del chars[k]
        else:
            chars.insert(k, rng.choice("xyz q"))
    return "".join(chars)


def test_bit_parallel_distance_equals_the_plain_one():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        want = least_edits(item, text)
        found = d.best_match(item, text, len(item))
        if found is None:
            assert not text
            continue
        errors, start, stop = found
        assert errors == want
        assert least_edits(item, text[start:stop]) == want


def test_pieces_cover_the_item():
    for errors in range(6):
        cut = d.pieces("abcdefghijk", errors)
        assert len(cut) == errors + 1 and "".join(p for _, p in cut) == "abcdefghijk"


def test_finds_every_match_within_the_budget(spark):
    rng = random.Random(2)
    items = [(k, prose(rng, rng.randint(8, 40), 60)) for k in range(12)]
    items += [(50, "tiny item"), (51, None), (52, " "), (53, items[0][1].upper()), (None, "words nobody asked for at all")]
    rows, long = [], prose(rng, 3000, 60)
    for k in range(60):
        item = items[rng.randrange(12)][1]
        body = spoil(rng, item, rng.randint(0, max(1, int(0.09 * len(item)))))
        rows.append((100 + k, f"{prose(rng, 10, 60)}\n {body.title()}  {prose(rng, 10, 60)}", None, None, None, 0, "", "", ""))
    rows.append((400, long + " " + items[3][1] + " " + long, None, None, None, 0, "", "", ""))
    rows.append((401, "it is a tiny  Item.", None, None, None, 0, "", "", ""))
    rows.append((402, "a tiny items", None, None, None, 0, "", "", ""))
    rows += awkward(rng)
    got = {(r["doc_id"], r["item_id"]): r for r in d.find(table(spark, rows), spark.createDataFrame(items, ITEMS), block_chars=300).collect()}
    for doc, text, *_ in rows:
        flat = d.normalised(text)
        for item, wanted in items:
            if item is None or not (wanted or "").strip():
                continue
            norm = d.normalised(wanted)
            budget = d.budget(len(norm))
            if item == 50:
                assert ((doc, item) in got) == (doc == 401)
                continue
            if len(flat) > 5000:
                assert ((doc, item) in got) == (norm in flat)
                continue
            want = least_edits(norm, flat)
            assert ((doc, item) in got) == (want <= budget), (doc, item, want, budget)
            if want <= budget:
                r = got[doc, item]
                assert r["errors"] == want
                assert least_edits(norm, d.normalised(text[r["start"]:r["stop"]])) == want
    kept = d.keep_unseen(table(spark, rows), spark.createDataFrame(items, ITEMS), block_chars=300)
    hit = {doc for doc, _ in got}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in hit)
    assert kept.columns == table(spark, rows).columns


def test_items_without_an_id_are_searched_for(spark):
    rng = random.Random(4)
    lost, known = prose(rng, 20, 5000), prose(rng, 20, 5000)
    rows = [
        (1, f"before {lost} after", None, None, None, 0, "", "", ""),
        (2, f"before {spoil(rng, lost, 2)} after", None, None, None, 0, "", "", ""),
        (3, f"before {known} after {lost}", None, None, None, 0, "", "", ""),
        (4, prose(rng, 60, 5000), None, None, None, 0, "", "", ""),
    ]
    items = spark.createDataFrame([(None, lost), (None, lost.upper()), (7, known), (8, lost), (None, None)], ITEMS)
    found = d.find(table(spark, rows), items).select("doc_id", "item_id", "errors").collect()
    pairs = sorted(((r[0], r[1]) for r in found), key=str)
    assert pairs == sorted([(k, i) for k in (1, 2, 3) for i in (None, None, 8)] + [(3, 7)], key=str)
    assert all((r["errors"] == 0) == (r["doc_id"] != 2) for r in found)
    assert [r["doc_id"] for r in d.keep_unseen(table(spark, rows), items).collect()] == [4]
    unnamed = spark.createDataFrame([(None, lost)], ITEMS)
    assert [r["doc_id"] for r in d.keep_unseen(table(spark, rows), unnamed).collect()] == [4]


def test_empty_tables(spark):
    docs, items = table(spark, awkward(random.Random(3))), spark.createDataFrame([], ITEMS)
    assert d.find(docs, items).count() == 0 and d.keep_unseen(docs, items).count() == docs.count()
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "some words that are long enough")], ITEMS)
    assert d.find(empty, some).count() == 0 and d.keep_unseen(empty, some).count() == 0
