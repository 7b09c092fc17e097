"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to
``e = floor(rate * m)`` edits. Cut into e + 1 pieces, at least one piece then
occurs unchanged, so all pieces of all items go into one automaton that reads
each document once; around every piece hit the item is verified with Myers'
bit-parallel edit distance. No match within the budget can be missed.

Both sides are compared in lower case with every run of blanks as one space.
Items are the stated query set. They pass the driver in blocks of at most
``block_chars`` characters, and one block at a time is shipped to the tasks, so
neither grows with the documents or with the number of items. Documents are
never shuffled.

Defined results: items with a null or blank text match nothing; an item with a
null id is searched for like any other and reported with that null id; null and
empty documents hold nothing; items below ``exact_below`` characters must occur without edits
and between word edges; equal items are all reported; a document row that occurs
twice is reported twice. A pair is reported once, with its fewest edits and, of
those, the earliest place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.05
EXACT_BELOW = 24
BLOCK_CHARS = 1_000_000
FOUND = "struct<item:array<bigint>,errors:array<int>,start:array<int>,stop:array<int>>"


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def normalised(text: str | None) -> str:
    return " ".join(lowered(text or "").split())


def budget(size: int, rate: float = RATE, exact_below: int = EXACT_BELOW) -> int:
    return 0 if size < exact_below else int(rate * size)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of near equal length with their places in the item."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    at: dict[str, int] = {}
    for k, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << k
    return at


def distances(at: dict[str, int], size: int, text: str, *, anchored: bool) -> Iterator[int]:
    """Edits between the pattern and the best text ending at each character in turn.

    ``anchored``: that text starts at the first character; else anywhere.
    """
    full, last = (1 << size) - 1, 1 << (size - 1)
    up, down, score, carry = full, 0, size, int(anchored)
    for c in text:
        same = at.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = (plus << 1 | carry) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        yield score


def best_match(item: str, text: str, errors: int) -> tuple[int, int, int] | None:
    """Fewest edits, start and stop of the earliest best match of the item in a text."""
    best = (errors + 1, 0)
    for k, score in enumerate(distances(masks(item), len(item), text, anchored=False)):
        if score < best[0]:
            best = (score, k + 1)
    if best[0] > errors:
        return None
    score, stop = best
    back = text[max(0, stop - len(item) - score) : stop][::-1]
    for k, d in enumerate(distances(masks(item[::-1]), len(item), back, anchored=True)):
        if d == score:
            return score, stop - k - 1, stop
    raise AssertionError("a match has a start")


class Finder:
    """Finds the items of one block in texts."""

    def __init__(self, block: list[tuple[str, list[int | None]]], rate: float, exact_below: int) -> None:
        self.block = block
        self.errors = [budget(len(item), rate, exact_below) for item, _ in block]
        self.exact_below = exact_below
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for no, (item, _) in enumerate(block):
            for at, piece in pieces(item, self.errors[no]):
                places.setdefault(piece, []).append((no, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def _windows(self, text: str) -> dict[int, list[list[int]]]:
        """Where each item may lie, overlapping windows merged."""
        raw: dict[int, list[tuple[int, int]]] = {}
        if len(self.automaton):
            for end, (size, where) in self.automaton.iter(text):
                for no, at in where:
                    first, e = end - size + 1 - at, self.errors[no]
                    raw.setdefault(no, []).append((max(0, first - e), first + len(self.block[no][0]) + e))
        merged: dict[int, list[list[int]]] = {}
        for no, windows in raw.items():
            out: list[list[int]] = []
            for a, b in sorted(windows):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            merged[no] = out
        return merged

    def find(self, original: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item id, edits, start, stop) in characters of the original text."""
        text = normalised(original)
        found = []
        for no, windows in self._windows(text).items():
            item, ids = self.block[no]
            best = None
            for a, b in windows:
                if len(item) < self.exact_below:
                    at = re.search(rf"(?<!\w){re.escape(item)}(?!\w)", text[max(0, a - 1) : b + 1])
                    one = (0, at.start() + max(0, a - 1), at.end() + max(0, a - 1)) if at else None
                else:
                    one = best_match(item, text[a:b], self.errors[no])
                    one = one and (one[0], one[1] + a, one[2] + a)
                if one and (best is None or one < best):
                    best = one
            if best:
                found += [(i, *best) for i in ids]
        if not found:
            return []
        # From places in the normalised text back to the original.
        origin: list[int] = []
        for word in re.finditer(r"\S+", original):
            origin += ([word.start() - 1] if origin else []) + list(range(word.start(), word.end()))
        places = [(i, e, origin[a], origin[b - 1] + 1) for i, e, a, b in found]
        return sorted(places, key=lambda m: (m[0] is not None, m[0] or 0, *m[1:]))


def blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[str, list[int | None]]]]:
    """Distinct normalised items with their ids, in blocks of bounded size."""
    held: dict[str, list[int | None]] = {}
    size = 0
    rows = items.select("item_id", "text").filter(F.col("text").isNotNull())
    for row in rows.orderBy("item_id").toLocalIterator():
        text = normalised(row["text"])
        if not text:
            continue
        if text not in held and held and size + len(text) > block_chars:
            yield list(held.items())
            held, size = {}, 0
        if text not in held:
            size += len(text)
        held.setdefault(text, []).append(None if row["item_id"] is None else int(row["item_id"]))
    if held:
        yield list(held.items())


def _found(block: list[tuple[str, list[int | None]]], rate: float, exact_below: int, text: Column) -> Column:
    @F.pandas_udf(FOUND)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder(block, rate, exact_below)
        for texts in parts:
            rows = [finder.find(t) for t in texts]
            yield pd.DataFrame(
                {
                    name: pd.Series([[m[k] for m in r] for r in rows], dtype=object)
                    for k, name in enumerate(("item", "errors", "start", "stop"))
                }
            )

    # Marked so that the optimiser does not run the search once for the filter and once for the rows.
    return found.asNondeterministic()(text)


def find(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    rate: float = RATE,
    exact_below: int = EXACT_BELOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document row and item it holds: key, item_id, errors, start, stop."""
    out = None
    for block in blocks(items, block_chars):
        part = (
            docs.select(F.col(key), _found(block, rate, exact_below, F.col(text)).alias("__found"))
            .filter(F.size("__found.item") > 0)
            .select(
                key,
                F.explode(F.arrays_zip("__found.item", "__found.errors", "__found.start", "__found.stop")).alias("__m"),
            )
            .select(
                key, F.col("__m.item").alias("item_id"), F.col("__m.errors").alias("errors"),
                F.col("__m.start").alias("start"), F.col("__m.stop").alias("stop"),
            )
        )
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.filter(F.lit(False)).select(
            F.col(key), F.lit(0).cast("bigint").alias("item_id"),
            *[F.lit(0).alias(c) for c in ("errors", "start", "stop")],
        )
    return out


def keep_unseen(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    rate: float = RATE,
    exact_below: int = EXACT_BELOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Documents that hold no test item, all columns unchanged."""
    for block in blocks(items, block_chars):
        docs = docs.filter(F.size(_found(block, rate, exact_below, F.col(text))["item"]) == 0)
    return docs
