from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusflow.llm import url_filter as u
from corpusflow.llm.queries_url import RULES, judged

PAGES = "page_id long, url string, host string, path string, rule int, `a.b` string"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    tail = rest[end:]
    stop = min([k for k in (tail.find(c) for c in "?#") if k >= 0], default=len(tail))
    return rest[:end].translate(UPPER), tail[:stop]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def urls(rng):
    out = [
        None, "", "://", "no scheme", "http://", "http://NET/", "http://net", "http://a.NET/x?y#z", "http://xnet/", "x://é.Net/Ä",
        "http://www.example.net/en/1", "http://example.net/en", "http://example.com/de/", "http://m.example.com/DE/", "http://org/fr/",
        "http://a.org?x=/fr/", "http://a.org#://b.net/", "a://b://c.net/", "http://x.net:80/", "http://net/\nnew line", "http://x.org/fr/" + "a" * 50_000,
    ]
    hosts, paths = ["example.net", "Example.COM", "a.org", "b.b.net", "c.de"], ["/", "/en/1", "/de/2?x", "/fr/#t", ""]
    return out + [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.randrange(50)}" for _ in range(300)]


def test_parts_and_rules_equal_a_plain_version(spark):
    given = urls(random.Random(1))
    rows = [(k, x, "h", "p", 1, "c") for k, x in enumerate(given)] + [(3, given[3], None, None, None, None)]
    got = judged(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = cut(given[r["page_id"]])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), given[r["page_id"]]
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
        assert 0 <= r["score"] <= 1
    by_url = {}
    assert all(by_url.setdefault(given[r["page_id"]], r["verdict"]) == r["verdict"] for r in got)


def test_the_model_learns_from_labelled_urls(spark):
    rng = random.Random(2)
    made = [(f"http://{rng.choice('abc')}{rng.randrange(999)}.{'spamshop' if k % 2 else 'library'}.example/{rng.randrange(9999)}", k % 2) for k in range(300)]
    weights = u.train(spark.createDataFrame(made[:200], "url string, block int"), steps=20)
    score = u.probability(u.features(u.host(F.col("url")), u.path(F.col("url"))), weights)
    got = spark.createDataFrame(made[200:], "url string, block int").select("block", score.alias("s")).collect()
    assert sum((r["s"] >= 0.5) == bool(r["block"]) for r in got) >= 98


def test_no_labels_and_no_pages(spark):
    weights = u.train(spark.createDataFrame([], "url string, block int"))
    pages = spark.createDataFrame([(1, "http://x.example/a")], "page_id long, url string")
    assert u.judge(pages, RULES, weights).first()["__url_verdict"] == "allow"
    assert judged(spark.createDataFrame([], PAGES)).count() == 0
