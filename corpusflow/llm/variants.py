"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words that may be near, the longer one (of equally long ones the smaller in
code-point order) gives two disjoint chunks that cover it, the other one its grams at the
places where those chunks can stand. One edit touches one chunk at most, so the
other one is a gram of the other word: the first chunk at its own place, the second at a place
shifted by the difference in length, none or one. Grams elsewhere can meet no chunk and are not
made. Both sides meet on a hash of length class, side and chunk; what meets is
verified by a banded edit distance.

A chunk that many words share would pair them all. Such a group is not joined but
split: an edit that spares the shared chunk lies in the part it leaves over, so the same step
is taken on that part, with the shared chunks in the key. That ends with one character
left over, where a group holds as many words as there are characters; so what is joined stays in
proportion to the words, and no pair is lost. Levels are as many as the longest word can be halved.

Words come from whole texts. Only words and their counts are shuffled, combined in
every task first; texts are not.

Defined results: null texts have no word; a null document id is written as an empty
string in front of the colon; repeated rows count each; an empty table has no words; ties between
forms go to the smallest in code-point order. Other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.hot import join_counted
from corpusflow.session import settled

LEAST = 7
TWICE = 2
RATIO = 10
#: A group is joined while each of its rows meets so many others on average, and while it has at most ``TOGETHER`` rows.
EACH = 16
TOGETHER = 4_096


def _sub(word: str | Column, at: Column, size: Column) -> Column:
    return F.substring(word, at, size)


def vocabulary(docs: DataFrame, least: int = LEAST, twice: int = TWICE, slip: int = 31) -> DataFrame:
    """word and n of every word of at least ``least`` characters that occurs ``twice``; one run in ``slip`` loses a character."""
    lowered = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    # Whole runs: nothing a run could go on with is left out. Deleting never makes a word longer.
    runs = F.regexp_extract_all(lowered, F.lit("[A-Za-z\\u00C0-\\u00FF]{%d,}" % least), F.lit(0))
    run = F.col("run")
    place = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod("place", F.length(run)).cast("int")
    word = F.when(
        F.col("place") % slip == 0, F.concat(_sub(run, F.lit(1), at), _sub(run, at + 2, F.length(run)))
    ).otherwise(run)
    return (
        docs.select("doc_id", F.explode(runs).alias("run")).withColumn("place", place)
        .select(word.alias("word")).filter(F.length("word") >= least)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= twice)
    )


def _split(rows: DataFrame) -> DataFrame:
    """Two rows for each: one keeps the first half of what is left over in its key, one the second."""
    size, lo, short = F.col("size"), F.col("lo"), F.col("short")
    first = F.floor(size / 2).cast("int")
    second = size - first
    front = F.struct(lo.alias("lo"), first.alias("size"))
    keep_first = F.struct(
        F.xxhash64("key", F.lit(0), _sub("word", lo, first)).alias("key"),
        (lo + first).alias("lo"), second.alias("size"), F.col("fronts").alias("fronts"),
    )
    keep_second = F.struct(
        F.xxhash64("key", F.lit(1), _sub("word", lo + first - short, second)).alias("key"),
        lo.alias("lo"), first.alias("size"), F.concat("fronts", F.array(front)).alias("fronts"),
    )
    return rows.select("word", "n", "gram", "short", F.explode(F.array(keep_first, keep_second)).alias("x")).select(
        "word", "n", "gram", "short", "x.*"
    )


def near_pairs(words: DataFrame, each: int = EACH, together: int = TOGETHER, limit: int = 500_000) -> DataFrame:
    """a, a_n, b, b_n: all pairs of words exactly one edit apart, each once. ``words`` has one row per word."""
    size = F.length("word")
    none = F.array().cast("array<struct<lo:int,size:int>>")

    def role(gram: bool, short: int) -> Column:
        return F.struct(F.lit(gram).alias("gram"), F.lit(short).alias("short"))

    # As chunks a word meets grams of words of its length or one less; ``size`` is always that of the chunk side.
    rows = words.select("word", "n", F.explode(F.array(role(False, 0), role(True, 0), role(True, 1))).alias("as")).select(
        "word", "n", "as.*", (size + F.col("as.short")).cast("int").alias("size"), F.lit(1).alias("lo"), none.alias("fronts")
    )
    rows = _split(rows.withColumn("key", F.xxhash64("size")))
    found = []
    while True:
        rows = settled(rows)
        sizes = rows.groupBy("key").agg(
            F.count_if(~F.col("gram")).alias("chunks"), F.count_if("gram").alias("grams"), F.first("size").alias("left"),
            F.count(F.lit(1)).alias("rows"),
        )
        chunks, grams = F.col("chunks"), F.col("grams")
        crowded = (F.col("left") > 1) & ((chunks * grams > each * (chunks + grams)) | (F.col("rows") > together)) & (chunks > 0)
        heavy = settled(sizes.filter(crowded).select("key", "rows"))
        if heavy.isEmpty():
            found.append(_meet(rows))
            break
        marked = settled(join_counted(rows, heavy, "key", "rows", spread=F.struct("word", "gram", "short"), limit=limit))
        found.append(_meet(marked.filter("rows IS NULL").drop("rows")))
        rows = _split(marked.filter("rows IS NOT NULL").drop("rows"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def _meet(rows: DataFrame) -> DataFrame:
    a = rows.filter(~F.col("gram")).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), "fronts")
    b = rows.filter("gram").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "short")
    # A pair that two chunks bring together counts at the first of them.
    once = F.forall("fronts", lambda f: _sub("a", f["lo"], f["size"]) != _sub("b", f["lo"], f["size"]))
    return (
        a.join(b, "key")
        .filter((F.col("short") == 1) | (F.col("a") < F.col("b")))
        .filter(F.levenshtein("a", "b", 1) == 1)
        .filter(once)
        .select("a", "a_n", "b", "b_n")
    )


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: the commonest near word, if ``ratio`` times as common as the word."""
    one = F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("form")).alias("near"))
    two = F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("minus"), F.col("a").alias("form")).alias("near"))
    best = (
        pairs.select(F.explode(F.array(one, two)).alias("x")).select("x.*")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"))
    )
    n = -F.col("best.minus")
    leads = n >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(leads, F.col("best.form")).alias("form"), F.when(leads, n).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """word and root of all words whose form has a form itself, following forms to the last."""
    steps = formed.filter("form IS NOT NULL").select("word", "form")
    ends: DataFrame | None = None
    going = steps.select("word", F.col("form").alias("at"))
    while True:
        # Forms grow ``ratio`` times as common each step, so the steps are few.
        going = settled(going.join(steps.select(F.col("word").alias("at"), F.col("form").alias("root")), "at"))
        if going.isEmpty():
            return ends if ends is not None else going.select("word", "root")
        last = going.select("word", "root")
        ends = last if ends is None else ends.join(last.select("word"), "word", "left_anti").unionByName(last)
        going = going.select("word", F.col("root").alias("at"))


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = settled(vocabulary(docs))
    formed = settled(forms(words, near_pairs(words)))
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "form", "word").alias("root"), "n", "n_near", "form_n"
    )
