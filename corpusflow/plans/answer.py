"""Questions to sources to model input, for a whole table of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators import context, fusion, index, memory, profile
from corpusflow.operators.encode import Encoder, embed
from corpusflow.operators.filters import with_owner
from corpusflow.operators.fusion import PairScorer
from corpusflow.operators.ordered import largest
from corpusflow.session import fits_broadcast, settled
from corpusflow.sources import appended

# Partitions of a store of results, by hash of the question's key.
RESULT_BUCKETS = 16


@dataclass(frozen=True)
class Served:
    """A stored index (``operators/index.py``) that answers the searches instead of a scan of the chunks."""

    path: str
    probes: int
    parts: int = index.PARTS


def chosen(questions: DataFrame) -> DataFrame:
    """Questions with what they may choose themselves: ``mode`` (anything unknown is hybrid) and ``rerank`` (null is yes)."""
    mode = F.lower(F.col("mode")) if "mode" in questions.columns else F.lit("hybrid")
    rerank = F.col("rerank") if "rerank" in questions.columns else F.lit(True)
    return questions.withColumns(
        {"mode": F.when(mode.isin("vector", "lexical"), mode).otherwise("hybrid"), "rerank": F.coalesce(rerank, F.lit(True))}
    )


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    sessions: DataFrame,
    *,
    dim: int = 64,
    encoder: Encoder | None = None,
    scorer: PairScorer | None = None,
    filters: bool = False,
    stats: DataFrame | None = None,
    choices: bool = False,
    served: Served | None = None,
    failures: Observation | None = None,
) -> DataFrame:
    """Rewrite, search within scope, rerank, shape: source rows per question.

    ``chunks`` carry ``tokens`` and ``embedding``; ``questions``: query_id, text, user_id, top_k, candidate_k (null for
    the defaults). With ``choices`` each question's own ``mode`` and ``rerank`` count, otherwise all are hybrid and
    reranked. ``served`` names a stored index to search, whose cells must hold ``owner`` and ``session_id``.
    ``failures`` observes the scorer's failed batches and pairs.
    """
    spark = questions.sparkSession
    switched = chosen(questions if choices else questions.drop("mode", "rerank"))
    # Written once: several steps read the questions, and a filter above the encoder must not carry the rules into its input.
    rewritten = settled(context.rewrite_rooms(fusion.search_params(switched)).withColumn("text", F.col("rewritten")))
    asked = embed(rewritten, "text", dim=dim, side="query", encoder=encoder)
    scoped = with_owner(chunks, sessions)
    columns = ["doc_id", "url", "chunk_index", "content", "metadata"]
    if served is not None:
        best = index.hybrid_stored(
            spark, served.path, settled(asked), "candidate_k", probes=served.probes, chunks=scoped, filters=filters, scope=True,
            parts=served.parts, modes=choices,
        )
        hits = fusion.attach_chunks(best, chunks, columns, fits=fits_broadcast(asked, rows_each=largest(asked, "candidate_k")))
    else:
        find = fusion.search if choices else fusion.hybrid_search
        hits = find(asked, scoped, "candidate_k", filters=filters, scope=True, stats=stats, columns=columns)
    texts = rewritten.select("query_id", "text", "top_k", "rerank")
    ordered = fusion.rerank(hits.join(texts, "query_id"), "top_k", scorer, wanted="rerank" if choices else None, failures=failures)
    return fusion.shape_sources(ordered)


def _result_bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(RESULT_BUCKETS)).cast("int")


def _kept(asked: DataFrame, store: str, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Stored rows of the asked keys, of each key the newest result that is young enough; opens those keys' partitions only."""
    spark = asked.sparkSession
    numbers = sorted(r[0] for r in asked.select(_result_bucket(F.col("key"))).distinct().collect())
    rows = appended.read(spark, store, ["key", "position"], buckets=numbers)
    young = rows.filter((F.col("created_at") <= as_of) & (F.unix_micros(as_of) - F.unix_micros("created_at") < ttl_seconds * 1_000_000))
    return young.join(young.groupBy("key").agg(F.max("created_at").alias("created_at")), ["key", "created_at"])


def retrieve_kept(
    questions: DataFrame, chunks: DataFrame, sessions: DataFrame, store: str, as_of: Column, *, ttl_seconds: int = 300, **options
) -> DataFrame:
    """``retrieve`` with results kept in ``store`` between runs.

    A question whose key (text, user and everything else that changes a result) was answered less than ``ttl_seconds``
    before ``as_of`` is not searched again; of equal questions in a batch one is searched. A question that found nothing is
    kept too. The store is only added to.
    """
    spark = questions.sparkSession
    keyed = settled(questions.withColumn("key", fusion.query_key(questions)))
    nothing = spark.createDataFrame([], "key string, created_at timestamp")
    prior = _kept(keyed, store, as_of, ttl_seconds).select("key", "created_at") if appended.exists(spark, store) else nothing
    marked = settled(fusion.reuse_results(questions, prior, as_of, ttl_seconds))
    todo = settled(marked.filter("run").drop("cached", "run"))
    if not todo.isEmpty():
        found = retrieve(todo.drop("key"), chunks, sessions, **options).join(todo.select("query_id", "key"), "query_id").drop("query_id")
        # Position 0 says that the question was searched, whatever it found.
        rows = found.unionByName(todo.select("key", F.lit(0).alias("position")), allowMissingColumns=True)
        appended.write(rows.withColumn("created_at", as_of).withColumn("bucket", _result_bucket(F.col("key"))), store)
        if appended.grown(spark, store):
            appended.compact(spark, store, ["key", "position"])
    rows = _kept(keyed, store, as_of, ttl_seconds).filter("position > 0").drop("created_at")
    return keyed.select("query_id", "key").join(rows, "key").drop("key")


def whole_document_sources(questions: DataFrame, chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Source rows of the questions that ask about a document as a whole."""
    requests = questions.filter(context.is_meta_doc(F.col("text"))).select(
        "query_id", "user_id", "session_id", F.coalesce("top_k", F.lit(fusion.TOP_K)).alias("top_k")
    )
    picked = context.doc_chunks(chunks, sessions, requests).select("query_id", "chunk_id", "pos")
    # At most 20 rows per question, in document order.
    order = W.partitionBy("query_id").orderBy("pos")
    zero = F.lit(0.0)
    rows = fusion.attach_chunks(
        picked.withColumn("position", F.row_number().over(order)).drop("pos"),
        chunks,
        ["doc_id", "url", "chunk_index", "content", "metadata"],
        fits=fits_broadcast(questions, rows_each=context.SLICE_MAX),
    )
    scored = rows.withColumns(
        {"rerank_score": F.lit(None).cast("double"), "vector_score": zero, "lexical_score": zero, "rrf_score": zero}
    )
    # These snippets are cut without a mark.
    whole = F.substring(tx.squeeze(F.coalesce("content", F.lit(""))), 1, tx.SNIPPET_CHARS)
    return fusion.shape_sources(scored).withColumn("score", F.lit(1.0)).withColumn("snippet", whole)


def prompts(
    questions: DataFrame,
    sources: DataFrame,
    memories: DataFrame,
    user_context: DataFrame,
) -> DataFrame:
    return context.build_prompts(
        questions,
        context.sources_block(sources),
        context.memories_block(memories),
        context.profile_block(user_context),
    )


def recalled(questions: DataFrame, memories: DataFrame, as_of: Column, *, dim: int = 64, encoder: Encoder | None = None) -> DataFrame:
    return memory.recall(embed(questions, "text", dim=dim, side="query", encoder=encoder), memories, as_of)


def ask(
    questions: DataFrame,
    chunks: DataFrame,
    sessions: DataFrame,
    memories: DataFrame,
    user_context: DataFrame,
    as_of: Column,
    *,
    dim: int = 64,
    encoder: Encoder | None = None,
    scorer: PairScorer | None = None,
    results: str | None = None,
    choices: bool = False,
    served: Served | None = None,
    failures: Observation | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole table of questions to model inputs.

    Returns the source rows, one model input per question with sources, and the
    questions without any. A question about a document as a whole reads a slice
    of it; every other question is searched. ``questions``: query_id, text,
    user_id, session_id, top_k, candidate_k. ``results`` names a store of earlier results
    to reuse and add to; ``choices``, ``served`` and ``failures`` are those of ``retrieve``.
    """
    # Written once: each of these feeds several outputs.
    of_documents = settled(whole_document_sources(questions, chunks, sessions))
    searched = questions.join(of_documents.select("query_id").distinct(), "query_id", "left_anti")
    options = {"dim": dim, "encoder": encoder, "scorer": scorer, "choices": choices, "served": served, "failures": failures}
    hits = (
        retrieve(searched, chunks, sessions, **options) if results is None
        else retrieve_kept(searched, chunks, sessions, results, as_of, **options)
    )
    sources = settled(of_documents.unionByName(hits))
    found = recalled(questions, memories, as_of, dim=dim, encoder=encoder)
    return sources, prompts(questions, sources, found, user_context), context.no_context(questions, sources)


def profiles_to_refresh(
    memories: DataFrame, favorites: DataFrame, documents: DataFrame, sessions: DataFrame,
    profiles: DataFrame, as_of: Column,
) -> DataFrame:
    """Summariser input of every user whose profile is due."""
    counts = profile.signal_counts(memories, favorites, documents, sessions)
    due = profile.profile_decision(counts, profiles, as_of).filter("decision = 'refresh'")
    context_rows = profile.user_context(sessions, documents, favorites, memories, profiles)
    return profile.profile_text(context_rows.join(due.select("user_id"), "user_id", "left_semi"))
