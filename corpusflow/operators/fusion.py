"""Rank fusion, hybrid search, rerank and result shaping."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators import lexical, vector
from corpusflow.operators.ordered import largest, top_per_group
from corpusflow.session import BROADCAST_ROWS, fits_broadcast, join_checked

# --- fixed values -----------------------------------------------------------
RRF_K = 60
TOP_K = 8
MAX_TOP_K = 50
CANDIDATE_K = 32
# ---------------------------------------------------------------------------

DIGITS = 6
# (query texts, chunk texts) -> scores
PairScorer = Callable[[list[str], list[str]], list[float]]


def search_params(queries: DataFrame) -> DataFrame:
    """Defaults and clamps: top_k within 1..50, candidate_k at least top_k."""
    top = F.least(F.lit(MAX_TOP_K), F.greatest(F.lit(1), F.coalesce("top_k", F.lit(TOP_K))))
    return queries.withColumn("top_k", top.cast("int")).withColumn(
        "candidate_k", F.greatest(F.col("top_k"), F.coalesce("candidate_k", F.lit(CANDIDATE_K))).cast("int")
    )


def weight(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + rank)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over ranked lists of (query_id, chunk_id, rank)."""
    stacked = reduce(
        DataFrame.unionByName, [ranked.select("query_id", "chunk_id", "rank") for ranked in lists]
    )
    return stacked.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(weight(F.col("rank"), k)), DIGITS + 4).alias("rrf_score")
    )


def _as_vector_list(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        F.col("item_id").alias("chunk_id"),
        "rank",
        F.col("similarity").alias("vector_score"),
        F.lit(None).cast("double").alias("lexical_score"),
    )


def _as_lexical_list(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        "chunk_id",
        "rank",
        F.lit(None).cast("double").alias("vector_score"),
        F.col("lexical").alias("lexical_score"),
    )


def fuse(vector_hits: DataFrame, lexical_hits: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Both lists in one aggregation: scores of a missing side are 0."""
    both = _as_vector_list(vector_hits).unionByName(_as_lexical_list(lexical_hits))
    return both.groupBy("query_id", "chunk_id").agg(
        F.coalesce(F.max("vector_score"), F.lit(0.0)).alias("vector_score"),
        F.coalesce(F.max("lexical_score"), F.lit(0.0)).alias("lexical_score"),
        F.round(F.sum(weight(F.col("rank"), rrf_k)), DIGITS + 4).alias("rrf_score"),
    )


def attach_chunks(hits: DataFrame, chunks: DataFrame, columns: list[str], *, fits: bool) -> DataFrame:
    """Payload joined last, so texts never travel with the candidates."""
    return join_checked(chunks.select("chunk_id", *columns), hits, "chunk_id", small_fits=fits)


def _worded(queries: DataFrame) -> DataFrame:
    """Queries with something to search for: a blank question finds nothing."""
    return queries.filter(tx.trim_blank(F.col("text")) != "") if "text" in queries.columns else queries


def vector_hits(queries: DataFrame, chunks: DataFrame, k: int | str, *, filters: bool = False, scope: bool = False) -> DataFrame:
    items = chunks.withColumnRenamed("chunk_id", "item_id")
    return vector.knn(queries, items, k, filters=filters, scope=scope)


def choose(
    near: DataFrame, worded: DataFrame, queries: DataFrame, candidate_k: int | str = CANDIDATE_K, rrf_k: int = RRF_K, *, modes: bool = False
) -> DataFrame:
    """Both lists fused, best ``candidate_k`` (a number or a query column) per query.

    With ``modes`` the query's ``mode`` decides which score orders its rows.
    """
    ranked, order, limit = fuse(near, worded, rrf_k), "rrf_score", candidate_k
    asked = ["mode"] if modes else []
    if isinstance(candidate_k, str):
        asked, limit = [*asked, F.col(candidate_k).alias("__k")], F.col("__k")
    if asked:
        ranked = join_checked(ranked, queries.select("query_id", *asked), "query_id")
    if modes:
        chosen = (
            F.when(F.col("mode") == "vector", F.col("vector_score"))
            .when(F.col("mode") == "lexical", F.col("lexical_score"))
            .otherwise(F.col("rrf_score"))
        )
        only_hybrid = F.when(F.col("mode") == "hybrid", F.col("rrf_score")).otherwise(F.lit(0.0))
        ranked, order = ranked.withColumn("__order", chosen).withColumn("rrf_score", only_hybrid), "__order"
    return top_per_group(ranked, ["query_id"], [F.col(order).desc(), F.col("chunk_id")], limit).drop("__k", "__order")


def _attached(best: DataFrame, queries: DataFrame, chunks: DataFrame, candidate_k: int | str, columns: list[str] | None) -> DataFrame:
    if not columns:
        return best
    most = candidate_k if isinstance(candidate_k, int) else largest(queries, candidate_k)
    return attach_chunks(best, chunks, columns, fits=fits_broadcast(queries, rows_each=most, limit=BROADCAST_ROWS))


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    candidate_k: int | str = CANDIDATE_K,
    rrf_k: int = RRF_K,
    *,
    stats: DataFrame | None = None,
    filters: bool = False,
    scope: bool = False,
    columns: list[str] | None = None,
) -> DataFrame:
    """Vector and lexical lists fused, best ``candidate_k`` per query.

    ``candidate_k`` is a number or the name of a query column.
    ``queries``: query_id, text, embedding (and filters, user_id).
    ``chunks``: chunk_id, tokens, embedding and the payload ``columns``.
    """
    queries = _worded(queries)
    near = vector_hits(queries, chunks, candidate_k, filters=filters, scope=scope)
    worded = lexical.lexical_search(queries, chunks, candidate_k, stats=stats, filters=filters, scope=scope)
    return _attached(choose(near, worded, queries, candidate_k, rrf_k), queries, chunks, candidate_k, columns)


def search(
    queries: DataFrame,
    chunks: DataFrame,
    candidate_k: int | str = CANDIDATE_K,
    rrf_k: int = RRF_K,
    *,
    stats: DataFrame | None = None,
    filters: bool = False,
    scope: bool = False,
    columns: list[str] | None = None,
) -> DataFrame:
    """A batch whose rows choose ``mode`` hybrid, vector or lexical.

    Each side runs once over the queries that want it; the mode only decides
    which score orders a query's rows.
    """
    queries = _worded(queries)
    near = vector_hits(
        queries.filter(F.col("mode") != "lexical"), chunks, candidate_k, filters=filters, scope=scope
    )
    worded = lexical.lexical_search(
        queries.filter(F.col("mode") != "vector"), chunks, candidate_k, stats=stats, filters=filters, scope=scope
    )
    best = choose(near, worded, queries, candidate_k, rrf_k, modes=True)
    return _attached(best, queries, chunks, candidate_k, columns)


def search_status(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: mode used, fallback and hit counts.

    A hybrid query without any row reports the vector fallback, which is then
    empty too, because the vector side has no floor.
    """
    counts = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lexical_score") > 0).alias("words")
    )
    empty = (F.col("mode") == "hybrid") & F.col("n").isNull()
    return (
        queries.select("query_id", "mode")
        .join(counts, "query_id", "left")
        .select(
            "query_id",
            F.when(empty, "vector").otherwise(F.col("mode")).alias("mode"),
            F.when(empty, F.lit("lexical-empty")).alias("fallback"),
            F.coalesce("n", F.lit(0)).alias("hits"),
            F.coalesce("words", F.lit(0)).alias("lexical_hits"),
        )
    )


def overlap_score(query: Column, content: Column) -> Column:
    """Built-in pair scorer: share of the query's terms found in the text."""
    wanted = F.array_distinct(tx.tokens(query))
    found = F.size(F.array_intersect(wanted, tx.tokens(content)))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.round(found / F.size(wanted), DIGITS))


def model_score(query: Column, content: Column, scorer: PairScorer, batch_size: int = 64, *, wanted: Column | None = None) -> Column:
    """Any pair scorer: a struct of ``score`` and ``failed``.

    Only ``wanted`` pairs reach the scorer. A batch it fails on gets null scores and is counted by ``failed`` = 1 on its
    first pair.
    """

    @F.pandas_udf("score double, failed int")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for asked, texts, use in batches:
            out = pd.DataFrame({"score": np.nan, "failed": 0}, index=range(len(asked)))
            rows = np.flatnonzero(use.to_numpy(dtype=bool))
            for start in range(0, len(rows), batch_size):
                part = rows[start : start + batch_size]
                left = [(t or "").strip() or " " for t in asked.iloc[part]]
                right = [(t or "").strip() or " " for t in texts.iloc[part]]
                try:
                    got = [float(s) for s in scorer(left, right)]
                    if len(got) != len(left):
                        raise ValueError("one score per pair expected")
                    out.loc[part, "score"] = got
                except Exception:
                    out.loc[part[0], "failed"] = 1
            out["score"] = out["score"].astype(object).where(out["score"].notna(), None)
            yield out

    return score(query, content, F.lit(True) if wanted is None else wanted)


def rerank(
    candidates: DataFrame,
    k: int | str = TOP_K,
    scorer: PairScorer | None = None,
    *,
    query: str = "text",
    content: str = "content",
    wanted: str | None = None,
    failures: Observation | None = None,
) -> DataFrame:
    """Order candidates by a pair score and keep the best ``k`` per query.

    A query with one candidate, with a failed score, or whose ``wanted`` column is false keeps its earlier order
    (``rank``) and has no rerank score; null means wanted. Only pairs that can be ordered anew reach the scorer.
    ``failures`` observes failed_batches and failed_pairs of a scorer, known once the result has been computed.
    """
    per_query = W.partitionBy("query_id")
    several = F.count(F.lit(1)).over(per_query) > 1
    switch = F.lit(True) if wanted is None else F.coalesce(F.col(wanted), F.lit(True))
    asked = candidates.withColumn("__asked", several & switch)
    if scorer is None:
        scored = asked.withColumn("__score", F.when(F.col("__asked"), overlap_score(F.col(query), F.col(content))))
    else:
        got = model_score(F.col(query), F.col(content), scorer, wanted=F.col("__asked"))
        scored = asked.withColumn("__got", got).withColumn("__score", F.col("__got.score"))
        if failures is not None:
            scored = scored.observe(
                failures,
                F.coalesce(F.sum("__got.failed"), F.lit(0)).alias("failed_batches"),
                F.count_if(F.col("__asked") & F.col("__score").isNull()).alias("failed_pairs"),
            )
        scored = scored.drop("__got")
    whole = F.count("__score").over(per_query) == F.count(F.lit(1)).over(per_query)
    judged = scored.withColumn("reranked", F.col("__asked") & whole).withColumn(
        "rerank_score", F.when(F.col("reranked"), F.col("__score"))
    )
    limit = F.col(k) if isinstance(k, str) else k
    order = [F.col("rerank_score").desc_nulls_last(), F.col("rank")]
    ordered = judged.withColumn("position", F.row_number().over(per_query.orderBy(*order)))
    return ordered.filter(F.col("position") <= limit).drop("__score", "__asked")


def _nonzero(col: Column) -> Column:
    return F.nullif(col, F.lit(0.0))


def shape_sources(hits: DataFrame) -> DataFrame:
    """Source rows: sid, the first non-zero score, snippet; a zero rerank score is null."""
    return hits.select(
        "query_id",
        F.concat(F.lit("S"), F.col("position").cast("string")).alias("sid"),
        "position",
        F.col("chunk_id").alias("id"),
        "doc_id",
        "url",
        "chunk_index",
        F.coalesce(
            _nonzero(F.col("rerank_score")),
            _nonzero(F.col("rrf_score")),
            _nonzero(F.col("vector_score")),
            F.lit(0.0),
        ).alias("score"),
        _nonzero(F.col("rerank_score")).alias("rerank_score"),
        "vector_score",
        "lexical_score",
        "rrf_score",
        "content",
        tx.snippet(F.col("content")).alias("snippet"),
        "metadata",
    )


def parse_metadata(col: Column) -> Column:
    """Variant object from a JSON text; anything but an object becomes {}."""
    parsed = F.try_parse_json(col)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(F.coalesce(is_object, F.lit(False)), parsed).otherwise(F.parse_json(F.lit("{}")))


def query_key(queries: DataFrame) -> Column:
    """Hash of the normalised text and everything else that changes the result."""
    clean = F.lower(tx.squeeze(F.col("text")))
    parts = [clean.alias("q")] + [
        F.col(c)
        for c in ("mode", "top_k", "candidate_k", "rerank", "filters", "user_id")
        if c in queries.columns
    ]
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def reuse_results(queries: DataFrame, prior: DataFrame, as_of: Column, ttl_seconds: int = 300) -> DataFrame:
    """Adds ``key``, ``cached`` and ``run``.

    ``cached``: an earlier result of the same key is younger than the ttl.
    ``run``: this row must be computed; of equal keys in the batch only the
    first query id runs.
    """
    keyed = queries.withColumn("key", query_key(queries))
    fresh = (
        prior.filter(
            (F.col("created_at") <= as_of)
            & (F.unix_micros(as_of) - F.unix_micros("created_at") < ttl_seconds * 1_000_000)
        )
        .select("key")
        .distinct()
        .withColumn("__hit", F.lit(True))
    )
    # The first asker per key is a map-side minimum, not a sort of a hot key.
    first = keyed.groupBy("key").agg(F.min("query_id").alias("__first"))
    return (
        keyed.join(fresh, "key", "left")
        .join(first, "key")
        .withColumn("cached", F.col("__hit").isNotNull())
        .withColumn("run", F.col("__hit").isNull() & (F.col("query_id") == F.col("__first")))
        .drop("__hit", "__first")
    )
