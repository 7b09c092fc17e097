"""URL filters: longest matching rule, else a logistic regression on hashed character n-grams.

Host and path are cut by plain text rules. A rule names a host with all its
subdomains and a prefix of the path. URLs no rule decides are judged by a linear
model over the set of hashed character n-grams of host and path, trained from a
small labelled table of URLs, at most ``rows`` of them by hash of the URL. Only
column expressions touch the rows; per step the driver sees one number per
weight (``DIMENSIONS`` of them, whatever the data) and sends them back as one
literal.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and gets the model's base verdict; without labelled URLs the model
allows; rules of equal length are taken in text order; repeated rows each get
their row. ``judge`` keeps all other columns (names with ``__url`` are reserved).
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import columns
from corpusflow.session import settled

DIMENSIONS = 4096
GRAMS = (3, 4)
ROWS = 2_000
STEPS = 30
RIDGE = 1e-4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    name = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(name, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host_: Column, path_: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as (rule, verdict); null when none does."""
    table = F.array(
        *[
            F.struct(
                F.lit(r.host).alias("host"), F.lit("." + r.host).alias("under"), F.lit(r.path).alias("path"),
                F.lit(-len(r.host + r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"),
                F.lit(r.verdict).alias("verdict"),
            )
            for r in rules
        ]
    )
    fits = F.filter(
        table,
        lambda r: ((host_ == r["host"]) | F.endswith(host_, r["under"])) & F.startswith(path_, r["path"]),
    )
    best = F.array_min(F.transform(fits, lambda r: F.struct(r["size"], r["rule"], r["verdict"])))
    return F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict"))


def _grams(text: Column, space: str, dimensions: int) -> Column:
    none = F.array().cast("array<int>")

    def of(chars: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1)))
        hashed = F.transform(
            starts,
            lambda i: F.pmod(F.xxhash64(F.lit(space), F.array_join(F.slice(chars, i, n), "")), F.lit(dimensions)).cast("int"),
        )
        return F.when(F.size(chars) >= n, hashed).otherwise(none)

    # The characters are the one element of an array, so that they are cut once and not once per gram.
    cut = F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.element_at(F.transform(cut, lambda chars: F.concat(*[of(chars, n) for n in GRAMS])), 1)


def features(host_: Column, path_: Column, dimensions: int = DIMENSIONS) -> Column:
    """Distinct hashed n-grams of host and path, and the base feature in the last place."""
    name = F.concat(F.lit("^"), host_, F.lit("$"))
    return F.array_distinct(
        F.concat(_grams(name, "host", dimensions), _grams(path_, "path", dimensions), F.array(F.lit(dimensions)))
    )


def _margin(held: Column, weights: Sequence[float]) -> Column:
    """Sum of the weights over the root of the number of features, so every URL has norm one."""
    table = F.from_json(F.lit(json.dumps(list(weights))), "array<double>")
    total = F.aggregate(held, F.lit(0.0), lambda a, f: a + F.element_at(table, f + 1))
    return total / F.sqrt(F.size(held))


def probability(held: Column, weights: Sequence[float]) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_margin(held, weights)))


def train(
    labelled: DataFrame, *, rows: int = ROWS, steps: int = STEPS, dimensions: int = DIMENSIONS
) -> list[float]:
    """Weights from (url, block) rows, ``block`` 0 or 1; accelerated gradient steps.

    Each step is one pass over the sample: every URL's error is spread over its
    features and summed per feature.
    """
    sample = (
        labelled.filter("url IS NOT NULL AND block IS NOT NULL")
        .groupBy("url").agg(F.max("block").alias("block"))
        .orderBy(F.xxhash64("url"), "url").limit(rows)
    )
    data = settled(sample.select(features(host(F.col("url")), path(F.col("url")), dimensions).alias("f"), "block"))
    n = data.count()
    weights = look = [0.0] * (dimensions + 1)
    if n == 0:
        weights[dimensions] = -1.0
        return weights
    for step in range(steps):
        error = (probability(F.col("f"), look) - F.col("block")) / F.sqrt(F.size("f"))
        slopes = (
            data.select(F.explode("f").alias("f"), error.alias("e"))
            .groupBy("f").agg(F.sum("e").alias("e")).collect()
        )
        slope = [RIDGE * w for w in look]
        for row in slopes:
            slope[row["f"]] += row["e"] / n
        # Rows have norm one, so the loss bends by at most a quarter.
        new = [w - 3.9 * s for w, s in zip(look, slope, strict=True)]
        pull = step / (step + 3)
        look, weights = [a + pull * (a - b) for a, b in zip(new, weights, strict=True)], new
    if not all(math.isfinite(w) for w in weights):
        raise ArithmeticError("training did not converge")
    return weights


def with_parts(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    cut = pages.withColumn("__url_host", host(F.col(url))).withColumn("__url_path", path(F.col(url)))
    return cut.withColumn("__url_fit", fitting(F.col("__url_host"), F.col("__url_path"), rules))


def judge(pages: DataFrame, rules: Sequence[Rule], weights: Sequence[float], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and score, all prefixed ``__url_``."""
    score = probability(features(F.col("__url_host"), F.col("__url_path"), len(weights) - 1), weights)
    own = F.when(F.col("__url_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return (
        with_parts(pages, rules, url)
        .withColumn("__url_score", score)
        .select(
            *columns(pages), "__url_host", "__url_path",
            F.col("__url_fit.rule").alias("__url_rule"),
            F.coalesce("__url_fit.verdict", own).alias("__url_verdict"),
            "__url_score",
        )
    )
