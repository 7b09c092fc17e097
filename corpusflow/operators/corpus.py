"""Corpus preparation: classify, clean, chunk, extract facts, hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.functions import facts, keys
from corpusflow.functions import text as tx
from corpusflow.operators import chunking

# --- fixed values -----------------------------------------------------------
LISTING_PATHS = ["/units/", "/menziller/", "/kvartiry/", "/portfolio/"]
STATIC_PATHS = ["/about", "/contact", "/careers", "/privacy", "/terms"]
SITE_LANGUAGES = ["en", "az", "ru"]
DEFAULT_LANGUAGE = "en"
DEFAULT_DOC_TYPE = "article"
DESCRIPTION_CHARS = 500
MAX_PAGES = 400
MAX_TOTAL_CHARS = 500_000
# ---------------------------------------------------------------------------

# (class, regular expression over the URL), first match wins.
URL_RULES = [
    ("listing", "|".join(f"{p}[^/?#]" for p in LISTING_PATHS)),
    ("static", "|".join(f"{p}([/?#.]|$)" for p in STATIC_PATHS) + "|^https?://[^/]+/?([a-z]{2}/?)?$"),
]


def classify_urls(df: DataFrame, rules: list[tuple[str, str]] = URL_RULES, url: str = "url") -> DataFrame:
    """Adds ``doc_type`` by the first URL rule that matches, else the default."""
    tests = [F.when(F.col(url).rlike(pattern), F.lit(name)) for name, pattern in rules]
    return df.withColumn("doc_type", F.coalesce(*tests, F.lit(DEFAULT_DOC_TYPE)))


def language_from_url(df: DataFrame, languages: list[str] = SITE_LANGUAGES, url: str = "url") -> DataFrame:
    prefix = F.regexp_extract(F.col(url), "^https?://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    return df.withColumn(
        "language", F.when(prefix.isin(*languages), prefix).otherwise(F.lit(DEFAULT_LANGUAGE))
    )


def with_doc_id(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("doc_id", keys.doc_id(F.col(url)))


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Display parts of a URL: host, path and the prettified last segment."""
    host = F.split_part(F.regexp_replace(F.col(url), "^https?://", ""), F.lit("/"), F.lit(1))
    path = F.regexp_replace(F.col(url), "^https?://[^/]+", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.when(F.size(segments) > 0, F.element_at(segments, -1)).otherwise(F.lit(""))
    spaced = F.regexp_replace(last, "[-_]", " ")
    # Upper-case the first letter of every word, leave the others as they are.
    words = F.transform(
        F.split(spaced, "(?<![A-Za-z0-9_])(?=[a-z])"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))),
    )
    return (
        df.withColumn("host", host)
        .withColumn("path", path)
        .withColumn("pretty", F.array_join(words, ""))
    )


def display_title(df: DataFrame) -> DataFrame:
    """Upload file name, else the location, else the prettified path, else the host."""
    shown = F.coalesce(
        F.when(F.col("doc_type") == "upload", F.coalesce("filename", F.lit("Uploaded document"))),
        F.nullif(F.col("location"), F.lit("")),
        F.nullif(F.col("pretty"), F.lit("")),
        F.col("host"),
    )
    return df.withColumn("display_title", shown)


def dedup_by_content(df: DataFrame, keys_: list[str], order: list[str]) -> DataFrame:
    """One row per content key, the first by ``order``.

    A map-side minimum, so a page repeated millions of times costs one row per
    task in the shuffle.
    """
    rest = [c for c in df.columns if c not in keys_]
    first = df.groupBy(*keys_).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("__first")
    )
    return first.select(*keys_, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*df.columns)


def normalize(df: DataFrame, text: str = "markdown", out: str = "body") -> DataFrame:
    return df.withColumn(out, tx.normalize_text(F.col(text)))


def split_into(df: DataFrame, pieces: Column, index: str, out: str) -> DataFrame:
    return df.select("*", F.posexplode(pieces).alias(index, out))


def record_body(df: DataFrame) -> Column:
    """Markdown wins over content."""
    markdown = F.nullif(F.col("markdown"), F.lit(""))
    return F.coalesce(markdown, F.col("content")) if "content" in df.columns else markdown


def with_facts(df: DataFrame) -> DataFrame:
    """Adds the listing fact struct, null fields for other document types."""
    listing = F.col("doc_type") == "listing"
    found = facts.listing_facts(F.col("title"), F.col("markdown"))
    names = ["price", "currency", "bedrooms", "total_rooms", "bathrooms", "area_sqm",
             "listing_type", "property_type", "location"]
    return df.withColumn("__facts", F.when(listing, found)).withColumn(
        "metadata",
        F.struct(
            F.col("doc_type"),
            F.col("language"),
            *[F.col("__facts")[name].alias(name) for name in names],
        ),
    ).drop("__facts")


def prepare_documents(df: DataFrame) -> DataFrame:
    """Corpus records to documents: defaults, body, facts, description, hash."""
    with_defaults = (
        df.withColumn("doc_type", F.coalesce("doc_type", F.lit(DEFAULT_DOC_TYPE)))
        .withColumn("language", F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit(DEFAULT_LANGUAGE)))
        .withColumn("title", F.nullif(F.col("title"), F.lit("")))
    )
    described = (
        F.substring(F.nullif(F.col("source_metadata.description"), F.lit("")), 1, DESCRIPTION_CHARS)
        if "source_metadata" in df.columns
        else F.lit(None).cast("string")
    )
    return (
        with_facts(with_defaults)
        .withColumn("description", described)
        .withColumn("body", tx.normalize_text(record_body(df)))
        .withColumn("source_hash", keys.content_hash(F.col("body")))
    )


def chunk_documents(
    documents: DataFrame,
    max_chars: int = chunking.MAX_CHARS,
    overlap: int = chunking.OVERLAP,
    min_chars: int = chunking.MIN_CHARS,
) -> DataFrame:
    """Prepared documents to chunk rows.

    A listing is one chunk (its body, else its title); every other type goes
    through the splitter. Chunks carry the document's facts, so filters need no
    join.
    """
    whole = F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("title"))
    chunks = F.when(
        F.col("doc_type") == "listing",
        F.when(whole.isNull(), F.array().cast("array<string>")).otherwise(F.array(whole)),
    ).otherwise(chunking.chunk_text(F.col("body"), max_chars, overlap, min_chars))
    scope = ["session_id"] if "session_id" in documents.columns else []
    return with_chunk_keys(
        chunking.explode_chunks(documents, chunks).select(
            "doc_id", "url", "chunk_index", "content", "metadata", *scope
        )
    )


def with_chunk_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk_id", keys.chunk_id(F.col("doc_id"), F.col("chunk_index"))).withColumn(
        "content_hash", keys.content_hash(F.col("content"))
    )


def assemble_pages(fragments: DataFrame) -> DataFrame:
    """Positioned text fragments to one text per (doc_id, page).

    A page whose fragments are all empty keeps its row with empty text.
    """
    spoken = F.when(F.col("str") != "", F.struct("position", "str"))
    ordered = F.array_sort(F.collect_list(spoken))
    joined = F.array_join(F.transform(ordered, lambda f: f["str"]), " ")
    return fragments.groupBy("doc_id", "page").agg(tx.squeeze(joined).alias("text"))


def document_limits(pages: DataFrame) -> DataFrame:
    """Per document: page count, characters and the reason to reject it, if any."""
    return (
        pages.groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("total_pages"),
            F.sum(F.length("text")).alias("total_chars"),
            F.max(F.length(tx.normalize_text(F.col("text")))).alias("__longest"),
        )
        .withColumn(
            "reason",
            F.when(F.col("total_pages") > MAX_PAGES, "too_many_pages")
            .when(F.col("total_chars") > MAX_TOTAL_CHARS, "too_many_chars")
            .when(F.col("__longest") == 0, "no_text"),
        )
        .drop("__longest")
    )


def _page_pieces(pages: DataFrame, max_chars: int, overlap: int, min_chars: int) -> DataFrame:
    """All pieces of every page of the accepted documents."""
    accepted = document_limits(pages).filter("reason IS NULL").select("doc_id")
    body = tx.normalize_text(F.col("text"))
    return (
        pages.join(accepted, "doc_id", "left_semi")
        .withColumn("body", body)
        .select("doc_id", "page", chunking.chunk_text(F.col("body"), max_chars, overlap, min_chars).alias("pieces"))
    )


def dropped_chunks(
    pages: DataFrame,
    max_per_page: int = chunking.MAX_CHUNKS_PER_PAGE,
    max_chars: int = chunking.MAX_CHARS,
    overlap: int = chunking.OVERLAP,
    min_chars: int = chunking.MIN_CHARS,
) -> DataFrame:
    """Per accepted document: how many chunks ``chunk_pages`` leaves out beyond its limit per page."""
    beyond = F.greatest(F.size("pieces") - max_per_page, F.lit(0))
    return (
        _page_pieces(pages, max_chars, overlap, min_chars)
        .groupBy("doc_id")
        .agg(F.sum(beyond).alias("dropped_chunks"))
    )


def chunk_pages(
    pages: DataFrame,
    max_per_page: int = chunking.MAX_CHUNKS_PER_PAGE,
    max_chars: int = chunking.MAX_CHARS,
    overlap: int = chunking.OVERLAP,
    min_chars: int = chunking.MIN_CHARS,
) -> DataFrame:
    """Chunks of page texts with a chunk index that runs on across pages.

    Rejected documents drop out first, so a document has at most 400 pages
    here and the running count over its pages stays small. ``dropped_chunks``
    counts what lies beyond the limit per page.
    """
    cut = _page_pieces(pages, max_chars, overlap, min_chars).withColumn("pieces", F.slice("pieces", 1, max_per_page))
    earlier = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    based = cut.withColumn("__base", F.coalesce(F.sum(F.size("pieces")).over(earlier), F.lit(0)))
    return (
        based.select("doc_id", "page", "__base", F.posexplode("pieces").alias("__at", "content"))
        .withColumn("chunk_index", (F.col("__base") + F.col("__at")).cast("int"))
        .withColumn("content_hash", keys.content_hash(F.col("content")))
        .drop("__base", "__at")
    )
