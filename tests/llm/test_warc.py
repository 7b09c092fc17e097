from __future__ import annotations

import base64
import hashlib
import random
import struct
from collections import Counter

import zstandard

from corpusflow.llm import hot, warc
from corpusflow.llm.queries_warc import report
from tests.llm.cases import prose

SCHEMA = "page_id long, url string, html string, `a.b` int, digest string, payload string, n int, first string"


def awkward(rng):
    long, base = prose(rng, 60_000), "<html>" + prose(rng, 200)
    rows = [
        (3, "http://a/x y\r\nEvil: 1", base), (1, "http://é.org/ü?q=%41", base), (2, None, base), (None, "http://n", base), (4, "", None),
        (5, "u", ""), (-7, "u", "one\r\n\r\ntwo WARC/1.1\r\n\r\n"), (8, "u", long), (9, "u", long), (10, "u", "🙂 ünï"),
        (None, "v", "only without an id"), (None, "w", "only without an id"), (11, "t", "tie"), (11, "t", "tie"), (12, "t", "tie"),
    ]
    rows += [(100 + k, f"http://h{k % 5}/{k}", f"<html><head><title>{prose(rng, 3)}</title></head><body>{prose(rng, 80)}</body></html>") for k in range(120)]
    rows += [(500 + k, "copy", base) for k in range(150)]
    return [(*r, 0, "d", "p", 1, None) for r in rows]


def plain(rows):
    first = {}
    for page, _, html, *_ in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = Counter()
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        lead = first.get(html or "")
        seen = lead is not None and page != lead
        out[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if seen else "response", lead if seen else None] += 1
    return out


def test_read_back_equals_plain(spark):
    rows = awkward(random.Random(3))
    pages = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, report(pages).collect())) == plain(rows)
    # Too many repeated payloads to send to every task, some of them hot; small files.
    assert Counter(map(tuple, report(pages, limit=0, file_bytes=2_000).collect())) == plain(rows)


def test_payloads_and_urls_come_back(spark):
    rows = awkward(random.Random(4))
    got = warc.read(spark, warc.write(spark.createDataFrame(rows, SCHEMA)), payloads=True).collect()
    want = {(r[0], r[1]): (r[2] or "").encode() for r in rows}
    urls = {r["url"] for r in got}
    assert {None, "", "http://a/x%20y%0D%0AEvil:%201", "http://%C3%A9.org/%C3%BC?q=%41"} <= urls
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["payload"]) in {v for (page, _), v in want.items() if page == r["page_id"]}
    ids = {r["record_id"] for r in got if r["record_type"] == "response"}
    assert len(got) == len(rows) and len(ids) >= 125


def test_small_payloads_are_never_revisits(spark):
    rows = awkward(random.Random(5))
    got = report(spark.createDataFrame(rows, SCHEMA), least=100).collect()
    assert {r["payload_bytes"] >= 100 for r in got if r["record_type"] == "revisit"} == {True}
    assert sum(r["record_type"] == "revisit" for r in got) == sum(k[3] == "revisit" and k[1] >= 100 and n for k, n in plain(rows).items() for _ in range(n))


def test_file_layout(spark, tmp_path):
    """A leading skippable frame holds a dictionary without which no record can be read."""
    rows = awkward(random.Random(6))
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{tmp_path}/w")
    (path,) = (tmp_path / "w/files").iterdir()
    data = path.read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert dictionary[:4] == bytes.fromhex("37a430ec")
    held = zstandard.ZstdCompressionDict(dictionary)
    rest, seen = data[8 + size :], []
    assert zstandard.get_frame_parameters(rest).dict_id == held.dict_id() != 0
    while rest:
        frame = zstandard.ZstdDecompressor(dict_data=held).decompressobj()
        seen.append(frame.decompress(rest))
        rest = frame.unused_data
    assert len(seen) == len(rows) + 1 and all(s.startswith(b"WARC/1.1\r\nWARC-Type: ") for s in seen)
    assert b"Evil: 1\r\n" not in b"".join(seen)


def test_empty_and_single(spark):
    assert report(spark.createDataFrame([], SCHEMA)).count() == 0
    got = report(spark.createDataFrame([(1, "u", "x", 0, "", "", 0, "")], SCHEMA)).collect()
    assert [tuple(r)[:2] + tuple(r)[3:] for r in got] == [(1, 1, "response", None)]


def test_hot_key_is_dealt_in_parts(spark):
    rows = spark.range(20_000).selectExpr("id", "case when id % 3 = 0 then -1 else id end as k")
    small = rows.groupBy("k").count().withColumnRenamed("count", "n")
    joined = hot.join_counted(rows, small, "k", "n", hot=100, limit=2)
    assert joined.count() == 20_000 and joined.filter("n <> case when k = -1 then 6667 else 1 end").count() == 0
    per_task = joined.filter("k = -1").rdd.glom().map(len).collect()
    assert max(per_task) < 6_667
    every = hot.join_counted(rows, small, "k", "n", hot=100, limit=0)
    assert every.count() == 20_000 and every.filter("n <> case when k = -1 then 6667 else 1 end").count() == 0
