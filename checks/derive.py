"""The service tables, derived by Spark from the given tables.

``sqlkit`` says the same in SQL; both are plain projections, so every query
runs over the whole given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators import corpus as corpus_ops
from corpusflow.operators import encode, lexical
from corpusflow.operators.sessions import derive_title

DIM = 64
AS_OF = "2024-03-20 00:00:00"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def given(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that lies in fewer pieces than there are cores, spread
    over all of them; a table in many pieces is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Corpus records: one per document; lines become paragraphs."""
    doc = F.col("doc_id")
    url = F.concat(
        F.lit("http://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/articles/"), text(doc)
    )
    kind = F.when(doc % 3 == 0, "article").when(doc % 3 == 1, "static").otherwise("upload")
    return spread(given(spark, d, "documents")).select(
        doc.alias("doc_no"),
        F.substring(F.sha1(url), 1, 16).alias("doc_id"),
        url.alias("url"),
        F.concat(F.lit("Document "), text(doc), F.lit(", "), F.col("source")).alias("title"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("markdown"),
        kind.alias("doc_type"),
        F.col("lang").alias("language"),
        F.struct(F.col("text").alias("description")).alias("source_metadata"),
        F.when(doc % 3 == 2, text(doc % 100)).alias("session_id"),
        (1 + F.floor(F.col("n_chars") / 1000)).cast("bigint").alias("total_pages"),
        F.floor(F.col("n_chars") / 1024).cast("bigint").alias("size_kb"),
        F.timestamp_seconds(F.lit(1704067200) + doc * 60).alias("updated_at"),
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select(
        "doc_no", "doc_id", "url", "title", "doc_type", "language", "session_id", "total_pages", "size_kb", "updated_at"
    )


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Listing records from parts and nations; the facts written are known."""
    p, size = F.col("p_partkey"), F.col("p_size")
    price = F.round(F.col("p_retailprice") * 1000).cast("bigint")
    grouped = F.concat(
        text(F.floor(price / 1000)), F.lit(","), F.lpad(text(price % 1000), 3, "0")
    )
    language = F.when(p % 3 == 0, "en").when(p % 3 == 1, "az").otherwise("ru")
    money = (
        F.when(size % 4 == 0, F.concat(F.lit("$"), grouped))
        .when(size % 4 == 1, F.concat(F.lit("€ "), text(price)))
        .when(size % 4 == 2, F.concat(F.lit("AZN "), grouped))
        .otherwise(F.concat(grouped, F.lit(" ₼")))
    )
    kind = F.when(size % 4 == 0, "apartment").when(size % 4 == 1, "villa").when(size % 4 == 2, "office").otherwise("shop")
    deal = F.when(size % 2 == 1, "for sale").otherwise("for rent")
    rooms, area = 2 + size % 5, 40 + size * 3
    en = F.concat(text(rooms - 1), F.lit("-bedroom "), kind, F.lit(" "), deal, F.lit(", "), text(1 + size % 3),
                  F.lit(" bathrooms, "), text(area), F.lit(" sqm"))
    az = F.concat(text(rooms), F.lit(" otaqlı "), kind, F.lit(" "), deal, F.lit(", "), text(1 + size % 3),
                  F.lit(" hamam, "), text(area), F.lit(" kvm"))
    ru = F.concat(text(rooms), F.lit("-комнатная "), kind, F.lit(" "), deal, F.lit(", "), text(area), F.lit(" м²"))
    details = F.when(p % 3 == 0, en).when(p % 3 == 1, az).otherwise(ru)
    path = F.when(p % 3 == 0, "/en/units/").when(p % 3 == 1, "/az/menziller/").otherwise("/ru/kvartiry/")
    url = F.concat(F.lit("https://homes.example.com"), path, F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), text(p))
    nation = given(spark, d, "nation").select("n_nationkey", "n_name")
    # One file of few row groups: its splits may hold nothing, so the rows are always dealt anew.
    parts = given(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return (
        parts.repartition(2 * spark.sparkContext.defaultParallelism)
        .withColumn("n_nationkey", (p % 25).cast("int"))
        .join(nation, "n_nationkey", "left")
        .select(
            p.alias("doc_no"),
            F.substring(F.sha1(url), 1, 16).alias("doc_id"),
            url.alias("url"),
            F.concat(F.col("p_name"), F.lit(", "), F.coalesce("n_name", F.lit(""))).alias("title"),
            F.concat(F.lit("Price: "), money, F.lit("\n"), details, F.lit("\n"), F.col("p_brand")).alias("markdown"),
            F.lit("listing").alias("doc_type"),
            language.alias("language"),
        )
    )


def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks for retrieval: the paragraphs of every document."""
    body = tx.normalize_text(F.col("markdown"))
    facts = F.struct(F.col("doc_type").alias("doc_type"), F.col("language").alias("language"),
                     *[F.lit(None).cast(t).alias(n) for n, t in (
                         ("price", "double"), ("currency", "string"), ("bedrooms", "int"), ("total_rooms", "int"),
                         ("bathrooms", "int"), ("area_sqm", "double"), ("listing_type", "string"),
                         ("property_type", "string"), ("location", "string"))])
    return (
        corpus_ops.split_into(corpus(spark, d), tx.paragraphs(body), "chunk_index", "content")
        .select(
            (F.col("doc_no") * 10000 + F.col("chunk_index")).alias("chunk_id"),
            "doc_no", "doc_id", "url", "chunk_index", "content", "session_id",
            facts.alias("metadata"),
        )
    )


def search_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with tokens and the built-in vector."""
    return encode.embed(lexical.with_tokens(paragraph_chunks(spark, d)), "content", dim=DIM)


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every benchmark item is a query."""
    item = F.col("item_id")
    pieces = F.filter(F.transform(F.split("text", "[.!?]\\s+"), tx.trim_blank), lambda s: s != "")
    exploded = given(spark, d, "benchmark").select("item_id", F.posexplode(pieces).alias("at", "text"))
    return exploded.select(
        (item * 1000 + F.col("at")).alias("query_id"),
        "text",
        F.when(item % 4 != 3, F.concat(F.lit("u"), text(item % 20))).alias("user_id"),
        text(item % 100).alias("session_id"),
        F.when(F.col("at") % 3 == 0, "hybrid").when(F.col("at") % 3 == 1, "vector").otherwise("lexical").alias("mode"),
        F.when(F.col("at") % 2 == 0, (item % 70).cast("int")).alias("top_k"),
        F.when(item % 2 == 0, (item % 90).cast("int")).alias("candidate_k"),
        item.alias("item_id"),
    )


def with_filters(queries: DataFrame) -> DataFrame:
    """A language filter for two of three queries, a type filter for one of two."""
    from corpusflow.operators.filters import filters_struct

    q = F.col("query_id")
    languages = F.when(q % 3 == 0, F.array(F.lit("en"))).when(q % 3 == 1, F.array(F.lit("en"), F.lit("fr")))
    types = F.when(q % 2 == 0, F.array(F.lit("article"), F.lit("upload")))
    return queries.withColumn("filters", filters_struct(language=languages, doc_type=types))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return encode.embed(questions(spark, d), "text", dim=DIM, side="query")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return (
        given(spark, d, "conversations")
        .filter(F.col("role").isin("user", "assistant"))
        .withColumn("created_at", F.timestamp_seconds(F.lit(1709251200) + conv * 3600 + turn * 60))
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    bot = F.col("role") == "assistant"
    mark = F.when(turn % 4 != 3, F.concat(F.lit(" [S1][S"), text(1 + (conv + turn) % 9), F.lit("]"))).otherwise(F.lit(""))
    n = 1 + (conv * 7 + turn) % 5
    sources = F.transform(
        F.sequence(F.lit(1).cast("bigint"), n),
        lambda i: F.struct(
            F.concat(F.lit("S"), i.cast("string")).alias("sid"),
            ((conv * 31 + turn * 7 + i * 13) % 97).alias("id"),
        ),
    )
    usage = F.concat(
        F.lit('{"model":"m'), text(conv % 3), F.lit('","usage":{"input_tokens":'), text(F.length("text")),
        F.lit(',"output_tokens":'), text(F.floor(F.length("text") / 4)),
        F.lit(',"cache_read_input_tokens":'), text(turn * 100),
        F.lit('},"stop_reason":"'), F.when(conv % 6 == 5, "max_tokens").otherwise("end_turn"),
        F.lit('","retrieval":{"mode":"'), F.when(turn % 3 == 0, "vector").otherwise("hybrid"),
        F.lit('","reranked":'), F.when(conv % 2 == 0, "true").otherwise("false"),
        F.lit(',"fallback":null,"cached":false,"topK":8}}'),
    )
    return _turns(spark, d).select(
        (conv * 1000 + turn).alias("id"),
        text(conv).alias("session_id"),
        "role",
        F.when(bot, F.concat(F.col("text"), mark)).otherwise(F.col("text")).alias("content"),
        F.when(bot, sources).alias("sources"),
        F.when(bot, usage).otherwise(F.lit("{}")).alias("metadata"),
        "created_at",
    )


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """One per conversation; every fifth has no title."""
    conv = F.col("conv_id")
    user = F.col("role") == "user"
    per = _turns(spark, d).groupBy("conv_id").agg(
        F.max("created_at").alias("updated_at"),
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("first"),
    )
    return per.select(
        text(conv).alias("session_id"),
        F.concat(F.lit("u"), text(conv % 20)).alias("user_id"),
        F.when(conv % 5 != 0, derive_title(F.col("first"))).alias("title"),
        F.timestamp_seconds(F.lit(1709251200) + conv * 3600).alias("created_at"),
        "updated_at",
    )


def memory(spark: SparkSession, d: str, dim: int | None = None) -> DataFrame:
    from corpusflow.operators.memory import build_memory

    return build_memory(messages(spark, d), sessions(spark, d), dim=dim)


def events(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def saves(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as requests to save a document; some name an unknown one."""
    e = F.col("event_id")
    no = e % 1100
    url_free_id = F.concat(F.lit("d"), text(no))
    return events(spark, d).filter("event_type = 'purchase'").select(
        e.alias("id"),
        F.concat(F.lit("u"), text(F.col("user_id") % 20)).alias("user_id"),
        no.alias("doc_no"),
        url_free_id.alias("doc_id"),
        F.when(F.col("value") > 20, F.concat(F.lit("note "), F.get_json_object("props", "$.k"))).alias("note"),
        F.col("ts").alias("created_at"),
    )


def documents_by_no(spark: SparkSession, d: str) -> DataFrame:
    """Documents under the short key that saves use."""
    return documents(spark, d).withColumn("doc_id", F.concat(F.lit("d"), text("doc_no")))


def favorites(spark: SparkSession, d: str) -> DataFrame:
    """Saves of known documents, one per user and document (the first)."""
    known = saves(spark, d).join(documents_by_no(spark, d).select("doc_id"), "doc_id", "left_semi")
    return (
        known.groupBy("user_id", "doc_id")
        .agg(F.min_by(F.struct("id", "note", "created_at"), "id").alias("f"))
        .select("f.id", "user_id", "doc_id", "f.note", "f.created_at")
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of the users among the first customers' market segments."""
    c = F.col("c_custkey")
    return (
        given(spark, d, "customer")
        .groupBy((c % 25).alias("n"))
        .agg(F.min("c_custkey").alias("first"), F.count(F.lit(1)).alias("size"))
        .select(
            F.concat(F.lit("u"), text("n")).alias("user_id"),
            F.concat(F.lit("Looks for "), text("size"), F.lit(" things")).alias("summary"),
            (F.col("n") % 7).cast("bigint").alias("basis_memory_n"),
            (F.col("n") * 3).cast("bigint").alias("basis_favorite_n"),
            (F.col("n") % 4).cast("bigint").alias("basis_upload_n"),
            F.timestamp_seconds(F.lit(1710892800) - F.col("n") * 10).alias("refreshed_at"),
            F.timestamp_seconds(F.lit(1710892800) - F.col("n") * 10).alias("updated_at"),
        )
    )


def upload_parts(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups as parts of uploads: repeats, gaps and bad names occur."""
    e = F.col("event_id")
    group = F.floor(e / 40).cast("bigint")
    digest = F.md5(F.concat(F.lit("up"), text(group)))
    uuid = F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4),
        F.substring(digest, 17, 4), F.substring(digest, 21, 12),
    )
    part = F.floor((e % 40) / 12).cast("int")
    body = F.concat(
        F.when((part == 0) & (group % 6 != 0), "%PDF-").otherwise(""),
        F.lit("part "), text(part), F.lit(" "), F.col("props"),
    )
    return events(spark, d).filter("event_type = 'signup'").select(
        F.when(group % 11 == 0, digest).otherwise(uuid).alias("upload_id"),
        part.alias("part_index"),
        (1 + group % 3).cast("int").alias("total_parts"),
        F.concat(F.lit("file"), text(group), F.when(group % 7 == 0, ".txt").otherwise(".PDF")).alias("filename"),
        F.concat(F.lit("u"), text(group % 20)).alias("user_id"),
        F.lit(None).cast("string").alias("session_id"),
        F.when(e % 50 == 0, "").otherwise(body).cast("binary").alias("data"),
        F.col("ts").alias("created_at"),
    )


def error_log(spark: SparkSession, d: str) -> DataFrame:
    """Error events with a provider answer, a connection code or a database code."""
    k = F.col("event_id") % 16

    def pick(values: dict[int, object], kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for at, value in values.items():
            out = F.when(k == at, F.lit(value).cast(kind)).otherwise(out)
        return out

    return events(spark, d).filter("event_type = 'error'").select(
        F.col("event_id").alias("id"),
        pick(ERROR_NAMES, "string").alias("name"),
        pick(ERROR_STATUSES, "int").alias("status"),
        pick(ERROR_KINDS, "string").alias("type"),
        F.concat(pick(ERROR_MESSAGES, "string"), F.lit(" "), F.col("props")).alias("message"),
        pick(ERROR_CODES, "string").alias("code"),
    )


ERROR_NAMES = {0: "AbortError", 1: "APIError", 2: "APIError", 3: "APIError", 4: "APIConnectionTimeoutError",
               5: "APIConnectionError", 6: "error", 7: "error", 8: "APIError", 9: "APIError", 10: "BadRequestError"}
ERROR_STATUSES = {1: 429, 2: 400, 3: 400, 8: 408, 9: 402, 10: 422, 11: 529, 12: 503, 13: 404, 14: 418}
ERROR_KINDS = {1: "rate_limit_error", 2: "invalid_request_error", 9: "billing_error", 11: "overloaded_error"}
ERROR_MESSAGES = {2: "Your credit balance is too low", 3: "bad field", 6: "duplicate key", 7: "lost"}
ERROR_CODES = {6: "23505", 7: "ECONNRESET", 15: "ETIMEDOUT"}


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts per labelled document."""
    n = F.col("doc_id")
    docs = given(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return (
        given(spark, d, "labels")
        .join(docs, "doc_id")
        .select(
            text(n).alias("id"),
            F.concat(F.lit("c"), text(n % 8)).alias("category"),
            F.col("lang").alias("language"),
            F.when(F.col("quality") == 1, 3 + n % 3).when(n % 5 != 0, n % 4).cast("bigint").alias("faithfulness"),
            F.concat(F.lit("reason "), text(n)).alias("faithful_reason"),
            F.when(n % 9 != 0, 2 + n % 4).cast("bigint").alias("relevance"),
            (F.col("toxic") == 0).alias("language_match"),
            F.when(F.col("toxic") == 1, n % 2 == 0).alias("refusal_correct"),
            F.when(n % 3 != 0, n % 7 != 0).alias("retrieval_recall"),
            (n % 10 != 0).alias("citations_valid"),
            (F.col("n_chars") / 100.0).alias("latency"),
        )
    )


def eval_questions(spark: SparkSession, d: str) -> DataFrame:
    """One question per benchmark item; its long words are the required keywords."""
    item = F.col("item_id")
    long_words = F.array_sort(F.array_distinct(F.filter(tx.tokens(F.col("text")), lambda t: F.length(t) >= 12)))
    return given(spark, d, "benchmark").select(
        text(item).alias("id"),
        item.alias("query_id"),
        F.col("text").alias("text"),
        F.concat(F.lit("c"), text(item % 8)).alias("category"),
        long_words.alias("must_match"),
        (item % 5 == 0).alias("no_match_expected"),
    )


def answer_lines(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as event lines: sources, model, one delta per line of text,
    usage and a closing event, with heartbeats and broken lines between."""
    m = messages(spark, d).filter("role = 'assistant'")
    pieces = F.split("content", "(?<=\\n)")
    deltas = F.transform(pieces, lambda p: F.concat(F.lit('data: {"type":"delta","text":'), F.to_json(F.array(p)), F.lit("}")))
    # to_json of a one-element array is ["..."]; keep the text between the brackets.
    deltas = F.transform(deltas, lambda s: F.regexp_replace(s, '(?s)"text":\\[(.*)\\]\\}$', '"text":$1}'))
    n = F.size("sources")
    sources = F.concat(
        F.lit('data: {"type":"sources","mode":"hybrid","sources":'), F.to_json("sources"), F.lit("}")
    )
    model = F.concat(F.lit('data: {"type":"model","model":"'), F.get_json_object("metadata", "$.model"), F.lit('"}'))
    usage = F.concat(
        F.lit('data: {"type":"usage","usage":'), F.get_json_object("metadata", "$.usage"), F.lit("}")
    )
    closing = F.when(
        F.col("id") % 10 == 9, F.lit('data: {"type":"error","kind":"overloaded","error":"busy","retryable":true}')
    ).otherwise(
        F.concat(F.lit('data: {"type":"done","stop_reason":"'), F.get_json_object("metadata", "$.stop_reason"), F.lit('"}'))
    )
    lines = F.concat(
        F.array(sources, model), deltas, F.array(usage, closing),
    )
    events_ = m.select(text("id").alias("request_id"), "created_at", F.posexplode(lines).alias("seq", "value"))
    return events_.select(
        "request_id", "seq", F.timestamp_seconds(F.unix_timestamp("created_at") + F.col("seq")).alias("ts"), "value"
    )
