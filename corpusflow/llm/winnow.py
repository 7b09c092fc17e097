"""Document fingerprints by winnowing.

Every run of ``GRAM`` words has a hash; in every window of ``WINDOW`` neighbouring
hashes the least is chosen, of equal ones the rightmost, and kept with its
position. Two texts that share ``GRAM + WINDOW - 1`` words in a row therefore share
a chosen hash, and nothing shorter than ``GRAM`` words is ever matched.

Runs and windows are built by doubling: pairs of hashes to runs of two, pairs of
those to runs of four, so the cost per word does not grow with either length.
Position and hash are one number, the hash in the high bits, so the least number
is the least hash and of equal ones the rightmost. All of it is column
expressions on one row per document, without a shuffle.

Defined results: null, empty and blank texts choose nothing; texts shorter than a
run are one run of all their words; texts with fewer runs than a window choose
their least one. Two empty fingerprints are alike (1), an empty and another are
not (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.common import columns, partitions, words
from corpusflow.session import join_checked, settled

GRAM = 4
WINDOW = 4
PLACES = (1 << 31) - 1


def _doubled(values: Column, length: int, join) -> Column:
    """Joins ``length`` (a power of two) neighbours at every place that has them."""
    step = 1
    while step < length:
        values = F.zip_with(
            F.slice(values, 1, F.greatest(F.size(values) - step, F.lit(0))),
            F.slice(values, step + 1, F.greatest(F.size(values) - step, F.lit(0))),
            join,
        )
        step *= 2
    return values


def chosen(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The winnowed runs of a text in order: hash (31 bits) and reversed place in one long."""
    # Each step is one element of a chain of one-element arrays, so that no step is spelled out twice.
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        return F.when(F.size(h) >= gram, _doubled(h, gram, lambda a, b: F.xxhash64(a, b))).when(
            F.size(h) > 0, F.array(F.xxhash64(h))
        ).otherwise(h)

    def placed(g: Column) -> Column:
        return F.transform(g, lambda x, i: F.shiftleft(x.bitwiseAND(PLACES), 31) + (F.lit(PLACES) - i).cast("bigint"))

    def least(k: Column) -> Column:
        return F.when(
            F.size(k) >= window, F.array_distinct(_doubled(k, window, lambda a, b: F.least(a, b)))
        ).when(F.size(k) > 0, F.array(F.array_min(k))).otherwise(k)

    out = F.array(hashes)
    for stage in (grams, placed, least):
        out = F.transform(out, stage)
    return F.element_at(out, 1)


def run_hashes(chosen_: Column) -> Column:
    """Distinct hashes without their places."""
    return F.array_distinct(F.transform(chosen_, lambda c: F.shiftright(c, 31).cast("int")))


def places(chosen_: Column) -> Column:
    """Word positions of the chosen runs, from 0."""
    return F.transform(chosen_, lambda c: (F.lit(PLACES) - c.bitwiseAND(PLACES)).cast("int"))


def digest(chosen_: Column) -> Column:
    """Names a fingerprint, hashes and places: 128 bits in hex."""
    return F.lower(
        F.concat(F.lpad(F.hex(F.xxhash64(F.lit(1), chosen_)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(2), chosen_)), 16, "0"))
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct run hashes."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def with_following(rows: DataFrame, order: str, tie: str, carried: list[str], name: str = "__next") -> DataFrame:
    """Adds a struct of ``carried`` of the next row by ``order``; after the last comes the first.

    Rows are dealt to ranges of the order column by quantiles and sorted inside, so
    they move once. Each range also gets a copy of the first row of the next one,
    found on ids alone, so no range waits for another. Ties follow ``tie``; nulls
    come first.
    """
    spark = rows.sparkSession
    pieces = 4 * partitions(spark)
    cuts = rows.agg(
        F.percentile_approx(order, [k / pieces for k in range(1, pieces)], 20 * pieces).alias("q")
    ).first()["q"]
    bounds = sorted(set(cuts or []))
    top = 1 << max(len(bounds), 1).bit_length()
    steps = F.array(*[F.lit(top >> k) for k in range(top.bit_length())])
    table = F.from_json(F.lit(str(bounds)), "array<bigint>")
    # Binary search: the number of bounds that are not above the value.
    part = F.when(F.col(order).isNull(), 0).otherwise(
        F.aggregate(
            steps, F.lit(0),
            lambda at, step: F.when(
                F.when(at + step <= len(bounds), F.element_at(table, F.least(at + step, F.lit(max(len(bounds), 1)))) <= F.col(order))
                .otherwise(False), at + step,
            ).otherwise(at),
        )
    )
    dealt = rows.withColumn("__part", part if bounds else F.lit(0))
    first = dealt.groupBy("__part").agg(F.min(F.struct(F.col(order).alias("k"), F.col(tie).alias("t"))).alias("f"))
    # One row per range.
    around = W.orderBy("__part")
    ends = settled(
        first.select(
            F.coalesce(F.lag("__part").over(around), F.max("__part").over(W.partitionBy())).alias("__end"),
            F.col("f.k").alias("__k"), F.col("f.t").alias("__t"),
        )
    )
    copies = (
        join_checked(rows, ends, F.col(order).eqNullSafe(F.col("__k")) & F.col(tie).eqNullSafe(F.col("__t")))
        # Rows that agree in order and tie are equal; one copy closes the range.
        .dropDuplicates(["__end"])
        .select(*columns(rows), F.col("__end").alias("__part"), F.lit(True).alias("__copy"))
    )
    both = dealt.withColumn("__copy", F.lit(False)).unionByName(copies)
    ahead = W.partitionBy("__part").orderBy("__copy", F.col(order).asc_nulls_first(), F.col(tie))
    return (
        both.withColumn(name, F.lead(F.struct(*carried)).over(ahead))
        .filter(~F.col("__copy")).drop("__part", "__copy")
    )


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the following text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))
