"""Retrieval and answer evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.memory import is_refusal
from corpusflow.operators.ordered import top_per_group
from corpusflow.operators.usage import extract_citations

# --- fixed values -----------------------------------------------------------
PASS_SCORE = 4
MAX_DROP = 0.05
METRICS = [
    "retrieval_recall", "citations_valid", "faithful", "relevant", "language_match", "refusal_correct",
]
# ---------------------------------------------------------------------------


def retrieval_recall(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question with ``must_match``: does any retrieved text hold a keyword?

    ``hits``: id, content, at most top_k rows per question.
    """
    asked = questions.filter(F.size(F.coalesce("must_match", F.array().cast("array<string>"))) > 0)
    tested = asked.select("id", "must_match").join(hits.select("id", "content"), "id", "left")
    found = F.exists("must_match", lambda k: F.contains(F.lower("content"), F.lower(k)))
    return tested.groupBy("id").agg(F.coalesce(F.bool_or(found), F.lit(False)).alias("retrieval_recall"))


def citation_validity(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Per answer: citations, invalid ones, and whether all exist in its sources."""
    cited = extract_citations(answers.select("id", F.col("answer").alias("content"))).select("id", "cited").distinct()
    known = hits.select("id", F.col("position").cast("bigint").alias("cited")).distinct()
    bad = cited.join(known, ["id", "cited"], "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("invalid"))
    good = cited.groupBy("id").agg(F.count(F.lit(1)).alias("citations"))
    return (
        answers.select("id")
        .join(good, "id", "left")
        .join(bad, "id", "left")
        .select(
            "id",
            F.coalesce("citations", F.lit(0)).alias("citations"),
            F.coalesce("invalid", F.lit(0)).alias("invalid"),
            F.col("invalid").isNull().alias("citations_valid"),
        )
    )


def refusal_check(answers: DataFrame) -> DataFrame:
    """Questions without a match must be refused; others have no verdict."""
    return answers.select(
        "id", F.when(F.col("no_match_expected"), is_refusal(F.col("answer"))).alias("refusal_correct")
    )


def forbidden_check(answers: DataFrame) -> DataFrame:
    """True when an answer holds any text of its ``should_not_invent`` list."""
    invented = F.exists("should_not_invent", lambda k: F.contains(F.lower("answer"), F.lower(k)))
    return answers.select("id", F.coalesce(invented, F.lit(False)).alias("invented"))


def judged(scores: DataFrame) -> DataFrame:
    """Adds pass flags for the scored dimensions; a missing score has none."""
    return scores.withColumn("faithful", F.col("faithfulness") >= PASS_SCORE).withColumn(
        "relevant", F.col("relevance") >= PASS_SCORE
    )


def _rates(metrics: list[str]) -> list[Column]:
    out: list[Column] = []
    for name in metrics:
        out += [
            F.count_if(F.col(name)).alias(f"{name}_pass"),
            F.count(name).alias(f"{name}_total"),
        ]
    return out


def eval_summary(flags: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Passes over non-null verdicts per metric, with mean latency."""
    return flags.agg(*_rates(metrics), F.round(F.avg("latency"), 6).alias("avg_latency"))


def eval_breakdown(flags: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """The same per category, per language and per both."""
    sets = [["category", "language"], ["category"], ["language"]]
    return flags.groupingSets(sets, "category", "language").agg(*_rates(metrics))


def eval_failures(flags: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """One row per failed metric with the verdict's own reason."""
    def reason(name: str) -> Column:
        return F.col(f"{name}_reason") if f"{name}_reason" in flags.columns else F.lit(None).cast("string")

    entries = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("passed"), reason(m).alias("reason"))
            for m in metrics
        ]
    )
    failed = F.filter(entries, lambda e: ~F.coalesce(e["passed"], F.lit(True)))
    return flags.select("id", F.explode(failed).alias("f")).select("id", "f.metric", "f.reason")


def as_metrics(summary: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Summary row to (metric, rate) rows."""
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.round(
                    F.when(F.col(f"{m}_total") > 0, F.col(f"{m}_pass") / F.col(f"{m}_total")), 6
                ).alias("rate"),
            )
            for m in metrics
        ]
    )
    return summary.select(F.explode(entries).alias("m")).select("m.metric", "m.rate")


def eval_gate(current: DataFrame, previous: DataFrame, most: float = MAX_DROP) -> DataFrame:
    """Metrics that fell by more than ``most`` of their earlier value."""
    before = previous.select("metric", F.col("rate").alias("before"))
    drop = F.when(F.col("before") > 0, (F.col("before") - F.col("rate")) / F.col("before"))
    return (
        current.join(before, "metric")
        .withColumn("drop", F.round(drop, 6))
        .withColumn("regressed", F.coalesce(F.col("drop") > most, F.lit(False)))
    )


def compare_modes(runs: dict[str, DataFrame]) -> DataFrame:
    """Share of passed questions per retrieval mode; ``runs``: id, retrieval_recall."""
    tagged = [df.withColumn("mode", F.lit(mode)) for mode, df in runs.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("mode").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("retrieval_recall").alias("passed"),
        F.round(F.avg(F.col("retrieval_recall").cast("double")), 6).alias("recall"),
    )


def balanced_split(questions: DataFrame, per_category: int, held_out: float) -> DataFrame:
    """At most ``per_category`` questions per category, in an order given by a
    hash of the id, and a stable held-out share."""
    digest = F.md5(F.col("id"))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    ordered = questions.withColumn("__digest", digest).withColumn(
        "split", F.when(share < held_out, "held_out").otherwise("train")
    )
    return top_per_group(
        ordered, ["category"], [F.col("__digest"), F.col("id")], per_category, "position"
    ).drop("__digest")


def majority_vote(scores: DataFrame) -> DataFrame:
    """Verdict per question over several judges: passed when more than half say so."""
    ayes, votes = F.count_if(F.col("passed")), F.count("passed")
    return scores.groupBy("id").agg(
        ayes.alias("ayes"), votes.alias("votes"), (ayes * 2 > votes).alias("passed")
    )
