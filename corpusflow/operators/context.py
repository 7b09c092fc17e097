"""Query rewriting, whole-document requests and the text handed to a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators.ordered import position_in_group

# --- fixed values -----------------------------------------------------------
AZ_ROOMS = f"(?iu)(?<!yataq[{tx.BLANK}])(\\d+)[{tx.BLANK}]*[-{tx.BLANK}]?[{tx.BLANK}]*otaq(?:lı|li)?(?=[^\\p{{L}}\\d]|$)"
RU_ROOMS = f"(?iu)(?<!спальня[{tx.BLANK}])(\\d+)[{tx.BLANK}]*[-{tx.BLANK}]?[{tx.BLANK}]*комнатн(?:ая|ой|ую|ые|ых)?(?=[^\\p{{L}}\\d]|$)"
DOC_VERB = (
    "(?i)\\b(analy[sz]e|summari[sz]e|review|brief|tl;?dr|overview|describe|extract|explain"
    "|tell me about|what(?: is|'s) (?:in|this))\\b"
)
DOC_TARGET = (
    "(?i)\\b(this|the|uploaded|attached|my) (doc(?:ument)?|file|pdf|brochure|contract|report|paper"
    "|tender|offer|spec|boq)\\b"
)
DOC_QUESTION = "(?i)^\\s*what\\b.*\\b(doc(?:ument)?|file|pdf|brochure|contract)\\b"
SHORT_REQUEST_CHARS = 80
SLICE_MIN = 8
SLICE_MAX = 20
SOURCE_GLUE = "\n\n---\n\n"
MEMORY_HEADER = (
    "Recalled from this user's previous conversations "
    "(advisory continuity context — NOT citable as facts):"
)
PROFILE_HEADER = (
    "USER PROFILE (personalization context — proactively reference when relevant; "
    "NOT citable as a factual source):"
)
NO_CONTEXT_ANSWER = "I could not find any relevant content in the knowledge base for this question."
PROFILE_FAVORITES = 12
PROFILE_TOPICS = 5
PROFILE_UPLOADS = 5
TOPIC_CHARS = 140
# ---------------------------------------------------------------------------


def _replace_counts(col: Column, pattern: str) -> Column:
    """Every "n rooms" phrase with n >= 1 becomes "(n-1)-bedroom"."""

    def replaced(text: Column) -> Column:
        found = F.struct(
            F.split(text, pattern).alias("between"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("phrases"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("numbers"),
        )
        return tx.let(found, joined)

    def joined(found: Column) -> Column:
        def phrase(at: Column) -> Column:
            rooms = F.get(found["numbers"], at).try_cast("bigint")
            return F.when(rooms >= 1, F.concat((rooms - 1).cast("string"), F.lit("-bedroom"))).otherwise(
                F.get(found["phrases"], at)
            )

        pieces = F.transform(found["between"], lambda piece, at: F.concat(piece, F.coalesce(phrase(at), F.lit(""))))
        return F.array_join(pieces, "")

    # Each text and each search is evaluated once, not once a piece.
    return tx.let(col, replaced)


def rewrite_rooms(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``rewritten`` and ``changed``: total-room counts become bedroom counts.

    Counts that follow the word for bedroom are left alone.
    """
    rewritten = _replace_counts(_replace_counts(F.col(text), AZ_ROOMS), RU_ROOMS)
    return df.withColumn("rewritten", rewritten).withColumn("changed", F.col("rewritten") != F.col(text))


def is_meta_doc(col: Column) -> Column:
    """True for requests about a document as a whole."""
    q = tx.trim_blank(F.coalesce(col, F.lit("")))
    verb = q.rlike(DOC_VERB)
    return (q != "") & (
        (verb & q.rlike(DOC_TARGET)) | (verb & (F.length(q) <= SHORT_REQUEST_CHARS)) | q.rlike(DOC_QUESTION)
    )


def stride_positions(total: Column, limit: Column) -> Column:
    """``limit`` positions spread evenly over 0..total-1, all when they fit."""
    step = (total - 1) / (limit - 1)
    spread = F.transform(
        F.sequence(F.lit(0), (limit - 1).cast("int")), lambda i: F.floor(i * step + 0.5).cast("bigint")
    )
    everything = F.sequence(F.lit(0).cast("bigint"), (total - 1).cast("bigint"))
    return F.when(total <= limit, everything).when(limit == 1, F.array(F.lit(0).cast("bigint"))).otherwise(spread)


def stride_sample(df: DataFrame, part: list[str], order: list[str], limit: int) -> DataFrame:
    """Evenly spread rows of each part, with their position ``pos`` and part size ``n``."""
    placed = position_in_group(df, part, order)
    if limit == 1:
        return placed.filter("pos = 0")
    step = (F.col("n") - 1) / F.lit(limit - 1)
    # The nearest stop to a position tells whether it is one of the stops.
    nearest = F.floor(F.col("pos") / step + 0.5)
    taken = [F.floor((nearest + shift) * step + 0.5) == F.col("pos") for shift in (-1, 0, 1)]
    on_stop = taken[0] | taken[1] | taken[2]
    return placed.filter((F.col("n") <= limit) | on_stop)


def doc_chunks(chunks: DataFrame, sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Representative slice for whole-document requests.

    ``requests``: query_id, user_id, session_id, top_k. Chunks of the current
    session win; without any, the user's other sessions serve. Chunks are
    numbered once per session and once per user; a request then joins only the
    positions it wants.
    """
    limit = F.greatest(F.lit(SLICE_MIN), F.least(F.lit(SLICE_MAX), F.greatest(F.lit(1), F.col("top_k"))))
    asked = requests.withColumn("limit", limit)
    private = chunks.filter("session_id IS NOT NULL").select("chunk_id", "doc_id", "chunk_index", "session_id")
    owned = private.join(sessions.select("session_id", "user_id"), "session_id")

    def pick(numbered: DataFrame, who: DataFrame, key: str) -> DataFrame:
        sizes = numbered.filter("pos = 0").select(key, "n")
        wanted = who.join(sizes, key).withColumn(
            "pos", F.explode(stride_positions(F.col("n"), F.col("limit")))
        )
        return wanted.select("query_id", key, "pos").join(
            numbered.select(key, "pos", "chunk_id", "doc_id", "chunk_index"), [key, "pos"]
        ).select("query_id", "pos", "chunk_id", "doc_id", "chunk_index")

    by_session = position_in_group(private, ["session_id"], ["doc_id", "chunk_index"])
    by_user = position_in_group(owned, ["user_id"], ["doc_id", "chunk_index"])
    current = pick(by_session, asked, "session_id").withColumn("origin", F.lit("session"))
    served = by_session.filter("pos = 0").select("session_id")
    left = asked.join(served, "session_id", "left_anti")
    other = pick(by_user, left, "user_id").withColumn("origin", F.lit("user"))
    return current.unionByName(other)


def plain_number(col: Column) -> Column:
    """Number as written in text: no trailing zeros, no exponent."""
    value = col.cast("double")
    written = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), "0+$", "")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(written)


def format_facts(metadata: Column) -> Column:
    """`` extracted_facts={…}`` in fixed order; empty when no fact is known."""

    def given(name: str) -> Column:
        return F.nullif(metadata[name], F.lit(""))

    price = F.concat(
        F.lit("price="), plain_number(metadata["price"]),
        F.coalesce(F.concat(F.lit(" "), given("currency")), F.lit("")),
    )
    parts = [price]
    for name in ("bedrooms", "bathrooms", "area_sqm"):
        parts.append(F.concat(F.lit(f"{name}="), plain_number(metadata[name])))
    for name in ("property_type", "listing_type"):
        parts.append(F.concat(F.lit(f"{name}="), given(name)))
    parts.append(F.concat(F.lit('location="'), given("location"), F.lit('"')))
    joined = F.concat_ws(", ", *parts)
    return F.when(joined != "", F.concat(F.lit(" extracted_facts={"), joined, F.lit("}"))).otherwise(F.lit(""))


def source_text(metadata: Column) -> Column:
    header = F.concat(
        F.lit("["), F.col("sid"), F.lit("] type="),
        F.coalesce(F.nullif(metadata["doc_type"], F.lit("")), F.lit("doc")),
        F.lit(" lang="), F.coalesce(F.nullif(metadata["language"], F.lit("")), F.lit("en")),
        format_facts(metadata),
        F.lit(" url="), F.coalesce(F.col("url"), F.lit("")),
    )
    return F.concat(header, F.lit("\n"), F.col("content"))


def ordered_text(order: Column, text: Column, glue: str) -> Column:
    """Texts of a small group joined in order (sources, turns, memories)."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), glue)


def sources_block(hits: DataFrame) -> DataFrame:
    """One text per query: its sources by position, at most top_k of them."""
    return hits.groupBy("query_id").agg(
        ordered_text(F.col("position"), source_text(F.col("metadata")), SOURCE_GLUE).alias("sources_block")
    )


def memories_block(memories: DataFrame) -> DataFrame:
    """One text per query from recalled memories (at most a handful each)."""
    when = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("earlier"))
    line = F.concat(F.lit("["), F.col("mid"), F.lit("] ("), when, F.lit(") "), F.col("content"))
    return memories.groupBy("query_id").agg(
        F.concat_ws("\n", F.lit(MEMORY_HEADER), ordered_text(F.col("position"), line, "\n")).alias("memories_block")
    )


def profile_block(context: DataFrame) -> DataFrame:
    """One text per user from the user context; empty when nothing is known."""
    titles = F.transform(F.slice("favorites", 1, PROFILE_FAVORITES), lambda f: f["title"])
    topics = F.transform(
        F.slice("topics", 1, PROFILE_TOPICS),
        lambda t: F.concat(F.lit("  - "), F.substring(t, 1, TOPIC_CHARS)),
    )
    files = F.transform(
        F.slice("uploads", 1, PROFILE_UPLOADS),
        lambda u: F.when(
            F.coalesce(u["total_pages"], F.lit(0)) > 0,
            F.concat(u["title"], F.lit(" ("), u["total_pages"].cast("string"), F.lit("p)")),
        ).otherwise(u["title"]),
    )
    summary = F.nullif(F.col("summary"), F.lit(""))
    known = summary.isNotNull() | (F.size("favorites") > 0) | (F.size("topics") > 0) | (F.size("uploads") > 0)
    body = F.concat_ws(
        "\n",
        F.lit(PROFILE_HEADER),
        F.concat(F.lit("Intent: "), summary),
        F.when(
            F.size("favorites") > 0,
            F.concat(F.lit("Saved listings ("), F.col("favorite_n").cast("string"), F.lit("): "),
                     F.array_join(titles, " · ")),
        ),
        F.when(F.size("topics") > 0, F.concat(F.lit("Recent topics:\n"), F.array_join(topics, "\n"))),
        F.when(F.size("uploads") > 0, F.concat(F.lit("Uploaded docs: "), F.array_join(files, " · "))),
    )
    return context.select("user_id", F.when(known, body).otherwise(F.lit("")).alias("profile_block"))


def build_prompts(
    queries: DataFrame, sources: DataFrame, memories: DataFrame, profiles: DataFrame
) -> DataFrame:
    """One model input per query that has sources.

    ``sources``, ``memories``: block per query; ``profiles``: block per user.
    Empty blocks leave no line.
    """
    joined = (
        queries.join(sources, "query_id")
        .join(memories, "query_id", "left")
        .join(profiles, "user_id", "left")
    )
    return joined.select(
        "query_id",
        tx.lines(
            F.col("profile_block"),
            F.col("memories_block"),
            F.concat(F.lit("Question: "), F.col("text")),
            F.lit("Sources:"),
            F.col("sources_block"),
        ).alias("prompt"),
    )


def no_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries without any source, with the fixed answer for them."""
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", F.lit(NO_CONTEXT_ANSWER).alias("answer"), F.lit("none").alias("mode")
    )


def trace_chunks(
    chunks: DataFrame,
    documents: DataFrame | None = None,
    *,
    chunk_id: int | None = None,
    doc_id: str | None = None,
    chunk_index: int | None = None,
    url: str | None = None,
) -> DataFrame:
    """Chunks behind a source card: by id, by (doc, index), by doc or by URL.

    Over a stored table start from ``sources.tables.lookup``, which opens only the partition of the document.
    """
    if chunk_id is not None:
        return chunks.filter(F.col("chunk_id") == chunk_id)
    if doc_id is not None:
        of_doc = chunks.filter(F.col("doc_id") == doc_id)
        return of_doc if chunk_index is None else of_doc.filter(F.col("chunk_index") == chunk_index)
    if url is None or documents is None:
        raise ValueError("give chunk_id, doc_id or url with documents")
    page = documents.filter(F.col("url") == url).select("doc_id")
    return chunks.join(page, "doc_id", "left_semi")


def trace_many(chunks: DataFrame, documents: DataFrame, urls: DataFrame) -> DataFrame:
    """Batch form: all chunks of the pages behind a table of URLs."""
    pages = documents.join(urls.select("url").distinct(), "url", "left_semi").select("doc_id", F.col("url").alias("page_url"))
    return chunks.join(pages, "doc_id")
