"""Usage analytics over messages, errors and request events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TOP_CITED = 20
CITED = "\\[S(\\d+)\\]"
PREVIEW_CHARS = 80
RATE_WINDOW = "60 seconds"
RATE_MAX = 30
ERROR_TYPES = {
    "rate_limit_error": "rate_limit",
    "authentication_error": "auth",
    "permission_error": "permission",
    "not_found_error": "model_unavailable",
    "invalid_request_error": "validation",
    "request_too_large": "request_too_large",
    "api_error": "server",
    "overloaded_error": "overloaded",
    "billing_error": "billing",
}
ERROR_STATUS = {
    408: "timeout",
    429: "rate_limit",
    401: "auth",
    403: "permission",
    404: "model_unavailable",
    413: "request_too_large",
    422: "validation",
    529: "overloaded",
}
BILLING = (
    "(?i)credit balance is too low|your balance is too low|insufficient credit|quota exceeded"
    "|payment required|billing"
)
ABORT_NAMES = ["AbortError", "APIUserAbortError"]
TIMEOUT_NAMES = ["APIConnectionTimeoutError"]
TIMEOUT_CODES = ["ETIMEDOUT", "UND_ERR_CONNECT_TIMEOUT"]
NETWORK_NAMES = ["APIConnectionError"]
NETWORK_CODES = ["ECONNRESET", "ENOTFOUND", "ECONNREFUSED"]
DB_CODE = "^[0-9A-Z]{5}$"
# Kinds a provider answer can end in; a status mapped elsewhere is looked at
# again by name and code.
PROVIDER_KINDS = [
    "rate_limit", "auth", "permission", "model_unavailable",
    "overloaded", "request_too_large", "validation", "server",
]
RETRYABLE = ["rate_limit", "overloaded", "server", "timeout", "network"]
SECRET_KEYS = ["authorization", "cookie", "apiKey", "api_key", "password", "token"]
# ---------------------------------------------------------------------------


def cited_sources(messages: DataFrame) -> DataFrame:
    """One row per source kept with an assistant turn."""
    return messages.filter((F.col("role") == "assistant") & F.col("sources").isNotNull()).select(
        F.col("id").alias("message_id"), "session_id", F.explode("sources").alias("source")
    )


def top_cited(messages: DataFrame, n: int = TOP_CITED) -> DataFrame:
    """Most cited chunks over all sessions."""
    counts = cited_sources(messages).groupBy(F.col("source.id").alias("chunk_id")).agg(
        F.count(F.lit(1)).alias("citations")
    )
    return counts.orderBy(F.col("citations").desc(), "chunk_id").limit(n)


def cited_in(messages: DataFrame, chunk_id: int) -> DataFrame:
    """Assistant turns whose sources hold the chunk."""
    return messages.filter(
        (F.col("role") == "assistant") & F.exists("sources", lambda s: s["id"] == chunk_id)
    ).select("id", "session_id", F.substring("content", 1, PREVIEW_CHARS).alias("preview"))


def turn_usage(messages: DataFrame, latest: int | None = None) -> DataFrame:
    """Model, tokens and retrieval mode per assistant turn; one JSON parse per row.

    ``latest`` keeps that many newest turns, as the report does.
    """
    meta = messages.filter(F.col("role") == "assistant").withColumn("__m", F.try_parse_json("metadata"))

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("__m", path, kind)

    turns = meta.select(
        "id",
        "session_id",
        field("$.model", "string").alias("model"),
        field("$.usage.input_tokens", "bigint").alias("in_tok"),
        field("$.usage.output_tokens", "bigint").alias("out_tok"),
        field("$.usage.cache_read_input_tokens", "bigint").alias("cache_read"),
        field("$.retrieval.mode", "string").alias("retrieval_mode"),
        field("$.retrieval.reranked", "boolean").alias("reranked"),
        "created_at",
    )
    return turns if latest is None else turns.orderBy(F.col("created_at").desc(), "id").limit(latest)


def usage_cost(turns: DataFrame, rates: DataFrame) -> DataFrame:
    """Tokens and cost per day and model.

    ``rates``: model, input_rate, output_rate, cached_rate, each per million
    tokens. The rate table has one row per model.
    """
    zero = F.lit(0)
    per = (
        turns.withColumn("day", F.to_date("created_at"))
        .groupBy("day", "model")
        .agg(
            F.count(F.lit(1)).alias("turns"),
            F.sum(F.coalesce("in_tok", zero)).alias("in_tok"),
            F.sum(F.coalesce("out_tok", zero)).alias("out_tok"),
            F.sum(F.coalesce("cache_read", zero)).alias("cache_read"),
        )
    )
    priced = per.join(rates, "model", "left")
    cost = (
        F.col("in_tok") * F.col("input_rate")
        + F.col("out_tok") * F.col("output_rate")
        + F.col("cache_read") * F.col("cached_rate")
    ) / F.lit(1e6)
    prompt = F.col("in_tok") + F.col("cache_read")
    return priced.select(
        "day", "model", "turns", "in_tok", "out_tok", "cache_read",
        F.round(cost, 6).alias("cost"),
        F.round(F.when(prompt > 0, F.col("cache_read") / prompt), 6).alias("cached_share"),
    )


def extract_citations(df: DataFrame, text: str = "content") -> DataFrame:
    """One row per citation marker, in order of appearance."""
    found = F.regexp_extract_all(F.col(text), F.lit(CITED), F.lit(1))
    return df.select("*", F.posexplode(found).alias("citation_index", "__n")).withColumn(
        "cited", F.col("__n").try_cast("bigint")
    ).drop("__n")


def classify_errors(log: DataFrame) -> DataFrame:
    """Adds ``kind``, ``retryable`` and ``reported_status``.

    ``log``: name, status, type, message, code; all nullable. The tests run in
    the order abort, billing, provider type or status, timeout, network,
    database, unknown.
    """
    def lookup(col: Column, table: dict) -> Column:
        return F.coalesce(*[F.when(col == key, F.lit(value)) for key, value in table.items()])

    status, name, code = F.col("status"), F.col("name"), F.col("code")
    by_status = F.coalesce(
        lookup(status, ERROR_STATUS), F.when(status >= 500, "server"), F.when(status >= 400, "validation")
    )
    mapped = F.coalesce(lookup(F.col("type"), ERROR_TYPES), by_status)
    provider = status.isNotNull() | name.endswith("Error")
    billing = (status == 400) & F.coalesce("message", F.lit("")).rlike(BILLING)
    kind = (
        F.when(name.isin(*ABORT_NAMES), "aborted")
        .when(billing, "billing")
        .when(provider & mapped.isin(*PROVIDER_KINDS), mapped)
        .when(name.isin(*TIMEOUT_NAMES) | code.isin(*TIMEOUT_CODES), "timeout")
        .when(name.isin(*NETWORK_NAMES) | code.isin(*NETWORK_CODES), "network")
        .when(code.rlike(DB_CODE), "db")
        .otherwise("unknown")
    )
    judged = log.withColumn("kind", kind)
    keeps_status = F.col("kind").isin("billing", "unknown", *PROVIDER_KINDS)
    return judged.withColumn("retryable", F.col("kind").isin(*RETRYABLE)).withColumn(
        "reported_status", F.when(keeps_status, status)
    )


def redact(df: DataFrame, keys: list[str] = SECRET_KEYS) -> DataFrame:
    """Drops secret columns, and secret keys of map columns."""
    out = df.drop(*[c for c in df.columns if c in keys])
    for field in out.schema.fields:
        if field.dataType.typeName() == "map":
            out = out.withColumn(field.name, F.map_filter(field.name, lambda k, _: ~k.isin(*keys)))
    return out


def over_limit(events: DataFrame, window: str = RATE_WINDOW, most: int = RATE_MAX) -> DataFrame:
    """Callers above ``most`` requests in a fixed window; counts combine map-side."""
    counts = events.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.filter(F.col("requests") > most).select(
        "user_id", F.col("w.start").alias("window_start"), "requests"
    )
