"""Mixing sources to target weights with nested hash thresholds.

Every document has a fixed place in the hash space of its source. A source that
must give ``target`` words gives whole passes over all its documents and, for
what is left, the documents below one threshold. The threshold comes from
histograms: words are summed by source and leading hash digit, the digit in
which the budget ends is found, and only documents inside that one bucket are
summed again by the next digit, until the bucket holds a single hash value.
Nothing is sorted, and a larger budget takes a superset of a smaller one.

Defined results: null or blank texts have size 0 and take nothing; a null source
is a source of its own, last in order; rows with equal ids share a hash, so they
are taken together or not at all; an empty table gives an empty table. Other
columns are kept, whatever their names (only names starting with ``__mix`` are
reserved).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.common import columns, n_words
from corpusflow.session import join_checked, settled

HASH_BITS = 60
DIGIT_BITS = 12


def place(key: Column, seed: str = "") -> Column:
    """Fixed place of a document in [0, 2^60): the first 15 hex digits of an MD5."""
    text = F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """Adds ``__mix_target`` to a table of sources with their ``__mix_total``.

    Sources by code point, null last, get the weights in turn. Together they get
    ``share`` times all words; none gets more than ``repeats`` times its own,
    and what that leaves over goes to the others by weight. A source is capped
    exactly when the level reached without it and all tighter ones exceeds its
    cap, so one running sum over the sources by tightness finds the level.
    The windows see one row per source, never documents.
    """
    order = W.orderBy(F.col("__mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("__mix_no"))
    everything = W.partitionBy()
    before = W.orderBy("__mix_tight", "__mix_place").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0.0)
    leveled = (
        sources.withColumn("__mix_place", F.row_number().over(order))
        .withColumn("__mix_no", ((F.col("__mix_place") - 1) % len(weights) + 1).cast("int"))
        .withColumn("__mix_weight", weight)
        .withColumn("__mix_cap", F.col("__mix_total").cast("double") * repeats)
        .withColumn("__mix_tight", F.col("__mix_cap") / F.col("__mix_weight"))
        .withColumn(
            "__mix_level",
            (F.sum("__mix_total").over(everything) * share - F.coalesce(F.sum("__mix_cap").over(before), none))
            / (F.sum("__mix_weight").over(everything) - F.coalesce(F.sum("__mix_weight").over(before), none)),
        )
        .withColumn(
            "__mix_level",
            F.min(F.when(F.col("__mix_level") <= F.col("__mix_tight"),
                         F.struct("__mix_tight", "__mix_place", "__mix_level"))).over(everything)["__mix_level"],
        )
    )
    target = F.least(F.col("__mix_cap"), F.coalesce(F.col("__mix_weight") * F.col("__mix_level"), F.col("__mix_cap")))
    return leveled.select("__mix_source", "__mix_total", target.alias("__mix_target"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source: whole passes, and where in the hash space the last one ends.

    ``sizes``: __mix_source, __mix_hash, __mix_size. Returns the source columns
    with ``__mix_passes`` and ``__mix_below``: documents with a hash below that
    are in one more pass. The boundary bucket is in it when that lands nearer to
    the target than leaving it out.
    """
    passes = F.floor(
        F.when(F.col("__mix_total") > 0, F.col("__mix_target") / F.col("__mix_total")).otherwise(0)
    ).cast("bigint")
    state = settled(
        wanted.withColumn("__mix_passes", passes)
        .withColumn("__mix_rest", F.col("__mix_target") - F.col("__mix_passes") * F.col("__mix_total"))
        .withColumn("__mix_prefix", F.lit(0).cast("bigint"))
        .withColumn("__mix_before", F.lit(0).cast("bigint"))
        .withColumn("__mix_after", F.col("__mix_total"))
        .withColumn("__mix_bits", F.lit(HASH_BITS))
        .withColumn("__mix_open", F.col("__mix_rest") > 0)
    )
    bits = HASH_BITS
    running = W.partitionBy("__mix_source").orderBy("__mix_digit")
    while bits > 0 and not state.filter("__mix_open").isEmpty():
        held, bits = bits, bits - DIGIT_BITS
        open_ = state.filter("__mix_open").select(
            F.col("__mix_source").alias("__mix_in"), "__mix_prefix", "__mix_before", "__mix_rest"
        )
        inside = F.col("__mix_source").eqNullSafe(F.col("__mix_in")) & (
            F.shiftright("__mix_hash", held) == F.col("__mix_prefix")
        )
        histogram = (
            join_checked(sizes, open_, inside)
            .groupBy(
                "__mix_source", "__mix_prefix", "__mix_before", "__mix_rest",
                F.shiftright("__mix_hash", bits).alias("__mix_digit"),
            )
            .agg(
                F.sum("__mix_size").alias("__mix_sum"),
                (F.min("__mix_hash") < F.max("__mix_hash")).alias("__mix_mixed"),
            )
        )
        ends = (
            histogram.withColumn("__mix_end", F.col("__mix_before") + F.sum("__mix_sum").over(running))
            .filter(F.col("__mix_end") > F.col("__mix_rest"))
            .groupBy(F.col("__mix_source").alias("__mix_in"))
            .agg(F.min(F.struct("__mix_digit", "__mix_end", "__mix_sum", "__mix_mixed")).alias("__mix_found"))
        )
        found = F.col("__mix_found")
        more = found.isNotNull()
        state = settled(
            join_checked(state, ends, F.col("__mix_source").eqNullSafe(F.col("__mix_in")), "left").select(
                "__mix_source", "__mix_total", "__mix_target", "__mix_passes", "__mix_rest",
                # A bucket that is not refined keeps its place at the finer scale.
                F.when(more, found["__mix_digit"])
                .otherwise(F.shiftleft("__mix_prefix", held - bits)).alias("__mix_prefix"),
                F.when(more, found["__mix_end"] - found["__mix_sum"])
                .otherwise(F.col("__mix_before")).alias("__mix_before"),
                F.when(more, found["__mix_end"]).otherwise(F.col("__mix_after")).alias("__mix_after"),
                F.coalesce(found["__mix_mixed"], F.lit(False)).alias("__mix_open"),
                F.when(more, F.lit(bits)).otherwise(F.col("__mix_bits")).alias("__mix_bits"),
            )
        )
    nearer = F.col("__mix_after") + F.col("__mix_before") < 2 * F.col("__mix_rest")
    low = F.shiftleft("__mix_prefix", bits)
    high = low + F.expr("shiftleft(1L, __mix_bits)")
    partial = F.col("__mix_rest") > 0
    return state.select(
        "__mix_source", "__mix_total", "__mix_target", "__mix_passes",
        F.when(partial, F.when(nearer, high).otherwise(low)).otherwise(F.lit(0)).alias("__mix_below"),
    )


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "",
) -> DataFrame:
    """``docs`` with size, source_size, target and taken, all prefixed ``__mix_``.

    The text is read once for the sizes and once for the result; everything in
    between works on one narrow row per document.
    """
    placed = [
        F.col(source).alias("__mix_source"),
        place(F.col(key), seed).alias("__mix_hash"),
        n_words(F.col(text)).alias("__mix_size"),
    ]
    sizes = settled(docs.select(*placed))
    per_source = sizes.groupBy("__mix_source").agg(F.sum("__mix_size").alias("__mix_total"))
    cut = thresholds(sizes, targets(per_source, weights, share, repeats)).withColumnRenamed("__mix_source", "__mix_in")
    again = F.when(F.col("__mix_hash") < F.col("__mix_below"), 1).otherwise(0)
    joined = join_checked(
        docs.select("*", *placed), cut, F.col("__mix_source").eqNullSafe(F.col("__mix_in"))
    )
    return joined.select(
        *columns(docs),
        "__mix_size",
        F.col("__mix_total").alias("__mix_source_size"),
        "__mix_target",
        (F.col("__mix_size") * (F.col("__mix_passes") + again)).alias("__mix_taken"),
        (F.col("__mix_passes") + again).alias("__mix_copies"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, columns unchanged.

    Documents without words weigh nothing in any mix and stay once.
    """
    mixed = mix(docs, **options)
    copies = F.when(F.col("__mix_size") > 0, F.col("__mix_copies")).otherwise(1).cast("int")
    return (
        mixed.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), copies)))
        .select(*columns(docs))
    )
