from __future__ import annotations

import pytest

from corpusflow.functions import facts, keys
from corpusflow.functions import text as tx
from corpusflow.functions.numbers import parse_number


def test_normalize_drops_images_and_keeps_link_text(one):
    raw = "A\r\nB ![x](http://i/1.png) [go](http://u) https://cdn.site.com/a.png  c\n\n\n\nD "
    assert one(tx.normalize_text, raw) == "A\nB go c\n\nD"


def test_normalize_is_stable(one):
    once = one(tx.normalize_text, "x \t y\n\n\n\nz")
    assert once == "x y\n\nz" and one(tx.normalize_text, once) == once


def test_squeeze_knows_the_no_break_space(one):
    assert one(tx.squeeze, "  a \n b ") == "a b"


def test_sections_start_at_headings(one):
    body = "intro\n# One\ntext\n## Two\nmore #no"
    assert one(tx.sections, body) == ["intro", "# One\ntext", "## Two\nmore #no"]
    assert one(tx.sections, "####### seven is no heading") == ["####### seven is no heading"]
    assert one(tx.sections, "") == []


def test_sentences_need_a_capital_after_the_blank(one):
    assert one(tx.sentences, 'One. Two! three? "Four" e.g. five. 6 ok') == [
        "One.", 'Two! three?', '"Four" e.g. five.', "6 ok",
    ]


@pytest.mark.parametrize("size,tail", [(240, ""), (241, "...")])
def test_snippet_length(one, size, tail):
    assert one(tx.snippet, "x" * size) == "x" * 240 + tail


def test_word_boundaries_hold_for_cyrillic(one):
    pattern = tx.word("аренда|kira")
    assert one(lambda c: c.rlike(pattern), "срочно АРЕНДА!") is True
    assert one(lambda c: c.rlike(pattern), "субаренда") is False


@pytest.mark.parametrize(
    "raw,value",
    [("1,250,000", 1250000.0), ("1.250.000", 1250000.0), ("1 250 000", 1250000.0), ("12,5", 12.5), ("x", None)],
)
def test_parse_number(one, raw, value):
    assert one(parse_number, raw) == value


@pytest.mark.parametrize(
    "text,price,currency",
    [
        ("$450,000\n3 bedrooms", 450000.0, "USD"),
        ("450,000 ₼", 450000.0, "AZN"),
        ("₼ 900 or $1,200", 1200.0, "USD"),
        ("$50 deposit, € 2.500", 2500.0, "EUR"),
    ],
)
def test_price_rules_in_order(one, text, price, currency):
    got = one(facts.price, text)
    assert (got["price"], got["currency"]) == (price, currency)


def test_no_price_at_or_below_the_minimum(one):
    assert one(facts.price, "$100 fee") is None


@pytest.mark.parametrize(
    "text,bedrooms,rooms",
    [
        ("3 yataq otaqlı mənzil", 3, None),
        ("3 otaqlı mənzil", None, 3),
        ("4-комнатная квартира, 2 спальни", 2, 4),
        ("2-bedroom flat, 3 room", 2, 3),
    ],
)
def test_rooms_are_not_bedrooms(one, text, bedrooms, rooms):
    assert one(facts.bedrooms, text) == bedrooms
    assert one(facts.total_rooms, text) == rooms


def test_types_area_and_location(one):
    assert one(facts.property_type, "продается квартира") == "apartment"
    assert one(facts.listing_type, "Аренда офиса") == "rent"
    assert one(facts.area_sqm, "площадь 85,5 кв. м") == 85.5
    assert one(facts.location, "Flat, Sea Breeze, Baku ") == "Baku"
    assert one(facts.location, "Flat") is None


def test_doc_id_has_sixteen_hex_digits(one):
    import hashlib

    url = "https://example.com/a"
    assert one(keys.doc_id, url) == hashlib.sha1(url.encode()).hexdigest()[:16]


@pytest.mark.parametrize("blank", [" ", " ", " "])
def test_facts_allow_every_blank(one, blank):
    assert one(facts.price, f"450{blank}000{blank}₼")["price"] == 450000.0
    assert one(facts.price, f"${blank}450,000")["price"] == 450000.0
    assert one(facts.bedrooms, f"3{blank}bedroom flat") == 3
    assert one(facts.area_sqm, f"120{blank}m²") == 120.0
