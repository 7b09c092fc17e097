"""Corpus readers: JSON lines, eval sets and raw HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import schemas
from corpusflow.functions import keys
from corpusflow.functions import text as tx
from corpusflow.operators.corpus import classify_urls, language_from_url

# --- fixed values -----------------------------------------------------------
# Parts of a page that are not its content.
DROPPED = [
    "(?s)<!--.*?-->",
    "(?is)<script\\b.*?</script>",
    "(?is)<style\\b.*?</style>",
    "(?is)<noscript\\b.*?</noscript>",
    "(?is)<head\\b.*?</head>",
    "(?is)<nav\\b.*?</nav>",
    "(?is)<header\\b.*?</header>",
    "(?is)<footer\\b.*?</footer>",
    "(?is)<aside\\b.*?</aside>",
]
# Tags that become markdown; headings by level are added below.
MARKDOWN = [
    ("(?i)<br\\s*/?>", "\n"),
    ("(?i)<li\\b[^>]*>", "\n- "),
    ("(?i)</?(?:p|div|section|article|main|ul|ol|table|tr|blockquote|pre)\\b[^>]*>", "\n\n"),
]
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]
# ---------------------------------------------------------------------------

HEADINGS = [
    rule
    for level in range(1, 7)
    for rule in ((f"(?i)<h{level}\\b[^>]*>", "\n\n" + "#" * level + " "), (f"(?i)</h{level}>", "\n\n"))
]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One record per page; unreadable lines keep their text in _corrupt_record."""
    return (
        spark.read.schema(schemas.CORPUS_RECORD)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.EVAL_QUESTION)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def unescape(col: Column) -> Column:
    for entity, char in ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def page_title(html: Column) -> Column:
    """``<title>``, else the first H1, else null."""
    def text_of(pattern: str) -> Column:
        inner = F.regexp_extract(html, pattern, 1)
        clean = tx.squeeze(unescape(F.regexp_replace(inner, "<[^>]*>", "")))
        return F.nullif(clean, F.lit(""))

    return F.coalesce(text_of("(?is)<title\\b[^>]*>(.*?)</title>"), text_of("(?is)<h1\\b[^>]*>(.*?)</h1>"))


def page_markdown(html: Column) -> Column:
    body = html
    for pattern in DROPPED:
        body = F.regexp_replace(body, pattern, "")
    body = tx.rewrite_all(body, HEADINGS + MARKDOWN)
    body = unescape(F.regexp_replace(body, "<[^>]*>", ""))
    # Blank-only lines do not glue paragraphs together.
    return tx.normalize_text(F.regexp_replace(body, "(?m)^[ \\t]+$", ""))


def pages_to_corpus(pages: DataFrame) -> DataFrame:
    """Raw pages (url, html) to corpus records."""
    records = pages.select(
        keys.doc_id(F.col("url")).alias("doc_id"),
        "url",
        page_title(F.col("html")).alias("title"),
        page_markdown(F.col("html")).alias("markdown"),
    )
    return language_from_url(classify_urls(records))
