"""Column functions over text. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# White space in the sense of the source texts: ASCII plus the Unicode blanks.
BLANK = "\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
BLANK_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Clean-up rules for page markdown, applied in this order.
CLEANUP_RULES = [
    ("\\r\\n?", "\n"),
    ("!\\[[^\\]]*\\]\\([^)]*\\)", ""),
    (f"https?://cdn\\.[^{BLANK}]+", ""),
    ("\\[([^\\]]+)\\]\\([^)]*\\)", "$1"),
    # Single spaces are left alone: the same text, without rewriting all of it.
    ("\\t[\\t ]*| [\\t ]+", " "),
    ("\\n{3,}", "\n\n"),
]
HEADING_START = f"(?m)(?=^#{{1,6}}[{BLANK}]+.)"
PARAGRAPH_BREAK = "\\n{2,}"
SENTENCE_BREAK = f"(?<=[.!?])[{BLANK}]+(?=[A-Z0-9\"'(\\[])"
TOKEN_BREAK = "[^\\p{L}\\p{N}]+"
SNIPPET_CHARS = 240
# ---------------------------------------------------------------------------


def trim_blank(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANK_CHARS))


def squeeze(col: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(col, f"[{BLANK}]+", " "))


def rewrite_all(col: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1])), rules, col)


def normalize_text(col: Column) -> Column:
    return trim_blank(rewrite_all(F.coalesce(col, F.lit("")), CLEANUP_RULES))


def _pieces(col: Column, pattern: str) -> Column:
    parts = F.transform(F.split(col, pattern), trim_blank)
    return F.filter(parts, lambda p: p != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``, inside any expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sections(col: Column) -> Column:
    """Markdown split before each heading line."""
    whole = F.filter(F.array(trim_blank(col)), lambda p: p != "")
    return F.when(F.contains(col, F.lit("#")), _pieces(col, HEADING_START)).otherwise(whole)


def paragraphs(col: Column) -> Column:
    return _pieces(col, PARAGRAPH_BREAK)


def sentences(col: Column) -> Column:
    return _pieces(col, SENTENCE_BREAK)


def tokens(col: Column) -> Column:
    """Lower-case runs of letters or digits; no stemming, no stop words."""
    return F.filter(F.split(F.lower(col), TOKEN_BREAK), lambda t: t != "")


def ellipsis(col: Column, limit: int, keep: int, mark: str) -> Column:
    """Text over ``limit`` characters is cut to ``keep`` plus ``mark``."""
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, keep), F.lit(mark))).otherwise(col)


def snippet(col: Column, limit: int = SNIPPET_CHARS) -> Column:
    return ellipsis(squeeze(F.coalesce(col, F.lit(""))), limit, limit, "...")


def truncate(col: Column, limit: int) -> Column:
    return ellipsis(squeeze(F.coalesce(col, F.lit(""))), limit, limit - 1, "…")


def word(pattern: str, *, open_end: bool = False) -> str:
    """Case-insensitive pattern standing on its own between non-word letters.

    Boundaries are written out over Unicode letters, so Cyrillic and Azerbaijani
    alternatives match like the Latin ones. ``open_end`` is for word stems.
    """
    tail = "" if open_end else "($|[^\\p{L}\\p{N}_])"
    return f"(?iu)(^|[^\\p{{L}}\\p{{N}}_])({pattern}){tail}"


def lines(*parts: Column) -> Column:
    """Join by newline; null and empty parts leave no line."""
    return F.concat_ws("\n", *[F.when(p != "", p) for p in parts])
