"""Scans and corpus preparation (I, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derive, sqlkit
from checks.registry import flat, query
from checks.sqlkit import ctes
from corpusflow.functions import facts, keys
from corpusflow.functions import text as tx
from corpusflow.functions.numbers import parse_number
from corpusflow.operators import chunking, corpus, encode
from corpusflow.sources import corpus as corpus_source
from corpusflow.sources import events as event_source
from corpusflow.sources import tables, uploads
from corpusflow.streaming.run import fresh_dir

# ---- sources and sinks -----------------------------------------------------


@query(
    "I1_read_corpus",
    ctes("SELECT doc_id, url, title, doc_type, language, length(markdown) AS chars, substr(description, 1, 500) AS description, false AS corrupt FROM corpus"),
)
def read_corpus(spark, d):
    path = fresh_dir(spark, "corpus")
    derive.corpus(spark, d).select(
        "doc_id", "url", "title", "markdown", "doc_type", "language", "source_metadata"
    ).write.json(path)
    return flat(
        corpus_source.read_corpus(spark, path).select(
            "doc_id", "url", "title", "doc_type", "language",
            F.length("markdown").alias("chars"),
            F.substring("source_metadata.description", 1, 500).alias("description"),
            F.col("_corrupt_record").isNotNull().alias("corrupt"),
        )
    )


def _sql_unescape(e: str) -> str:
    for entity, char in corpus_source.ENTITIES:
        char = "''" if char == "'" else char
        e = f"replace({e}, '{entity}', '{char}')"
    return e


def _sql_regex(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sql_markdown(e: str) -> str:
    for pattern in corpus_source.DROPPED:
        e = f"regexp_replace({e}, '{_sql_regex(pattern)}', '', 'g')"
    for pattern, replacement in corpus_source.HEADINGS + corpus_source.MARKDOWN:
        parts = replacement.replace("\n", "' || chr(10) || '")
        e = f"regexp_replace({e}, '{_sql_regex(pattern)}', '{parts}', 'g')"
    e = _sql_unescape(f"regexp_replace({e}, '<[^>]*>', '', 'g')")
    return sqlkit.normalize(rf"regexp_replace({e}, '(?m)^[ \t]+$', '', 'g')")


def _sql_title(pattern: str) -> str:
    inner = f"regexp_extract(html, '{pattern}', 1)"
    clean = sqlkit.squeeze(_sql_unescape(f"regexp_replace({inner}, '<[^>]*>', '', 'g')"))
    return f"nullif({clean}, '')"


URL_TYPE = "CASE " + " ".join(
    f"WHEN regexp_matches(url, '{pattern}') THEN '{name}'" for name, pattern in corpus.URL_RULES
) + " ELSE 'article' END"


def url_language(languages: list[str]) -> str:
    prefix = "regexp_extract(url, '^https?://[^/]+/([a-z]{2})(?:[/?#]|$)', 1)"
    listed = ", ".join(f"'{name}'" for name in languages)
    return f"CASE WHEN {prefix} IN ({listed}) THEN {prefix} ELSE 'en' END"


@query(
    "I2_pages_to_corpus",
    f"""SELECT substr(sha1(url), 1, 16) AS doc_id, url,
        coalesce({_sql_title('(?is)<title[^>]*>(.*?)</title>')}, {_sql_title('(?is)<h1[^>]*>(.*?)</h1>')}) AS title,
        {_sql_markdown('html')} AS markdown, {URL_TYPE} AS doc_type, {url_language(corpus.SITE_LANGUAGES)} AS language
        FROM pages""",
)
def pages_to_corpus(spark, d):
    return corpus_source.pages_to_corpus(derive.given(spark, d, "pages").select("url", "html"))


@query(
    "I3_owned_sessions",
    ctes(f"SELECT session_id, user_id, title, {sqlkit.seconds('created_at')} AS created_at FROM sessions WHERE user_id = 'u7'"),
)
def owned_sessions(spark, d):
    path = fresh_dir(spark, "tables")
    derive.sessions(spark, d).write.parquet(f"{path}/sessions")
    df = tables.load_table(spark, path, "sessions", ["session_id", "user_id", "title", "created_at"])
    return flat(tables.owned(df, "u7"))


@query(
    "I4_write_chunks",
    ctes("SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM chunks GROUP BY doc_id"),
)
def write_chunks(spark, d):
    path = fresh_dir(spark, "chunks")
    tables.write_chunks(derive.paragraph_chunks(spark, d), path, buckets=16)
    return tables.read_chunks(spark, path).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars")
    )


@query(
    "I5_read_eval_set",
    ctes("SELECT id, text AS question, category, len(must_match) AS keywords, no_match_expected FROM eval_questions"),
)
def read_eval_set(spark, d):
    path = fresh_dir(spark, "eval")
    derive.eval_questions(spark, d).withColumnRenamed("text", "question").drop("query_id").write.json(path)
    return flat(
        corpus_source.read_eval_set(spark, path).select(
            "id", "question", "category", F.size("must_match").alias("keywords"), "no_match_expected"
        )
    )


@query(
    "I7_event_lines",
    ctes("""SELECT id::VARCHAR AS request_id, t AS type, count(*) AS events
            FROM (SELECT id, unnest(['sources', 'model', 'usage'] || [CASE WHEN id % 10 = 9 THEN 'error' ELSE 'done' END]
                    || list_transform(regexp_split_to_array(content, chr(10)), lambda x: 'delta')) AS t
                  FROM messages WHERE role = 'assistant')
            GROUP BY 1, 2"""),
)
def event_lines(spark, d):
    lines = derive.answer_lines(spark, d).select("request_id", "value")
    # Heartbeats, blank and broken lines stand around every event.
    noise = F.array(F.lit(": ping"), F.lit(""), F.lit("data:"), F.lit("data: {broken"), F.lit("retry: 3"))
    noisy = lines.select("request_id", F.explode(F.concat(F.array("value"), noise)).alias("value"))
    return event_source.parse_event_lines(noisy).groupBy("request_id", F.col("event.type").alias("type")).agg(
        F.count(F.lit(1)).alias("events")
    )


@query(
    "I8_upload_parts",
    ctes("SELECT upload_id, count(*) AS parts, sum(octet_length(encode(data)))::BIGINT AS bytes FROM parts GROUP BY upload_id"),
)
def upload_parts(spark, d):
    path = fresh_dir(spark, "parts")
    derive.upload_parts(spark, d).write.parquet(path)
    return uploads.read_upload_parts(spark, path).groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("parts"), F.sum(F.octet_length("data").cast("bigint")).alias("bytes")
    )


# ---- classification --------------------------------------------------------


@query(
    "P1_classify_urls",
    ctes(f"SELECT url, {URL_TYPE} AS doc_type FROM (SELECT url FROM pages UNION ALL SELECT url FROM listings)"),
)
def classify_urls(spark, d):
    urls = derive.given(spark, d, "pages").select("url").unionByName(derive.listings(spark, d).select("url"))
    return corpus.classify_urls(urls)


@query(
    "P2_language_from_url",
    ctes(f"SELECT url, {url_language(['en', 'az', 'ru', 'fr', 'de', 'es'])} AS language FROM (SELECT url FROM pages UNION ALL SELECT url FROM listings)"),
)
def language_from_url(spark, d):
    urls = derive.given(spark, d, "pages").select("url").unionByName(derive.listings(spark, d).select("url"))
    return corpus.language_from_url(urls, ["en", "az", "ru", "fr", "de", "es"])


@query("P3_doc_id", "SELECT url, substr(sha1(url), 1, 16) AS doc_id FROM pages")
def doc_id(spark, d):
    return corpus.with_doc_id(derive.given(spark, d, "pages").select("url"))


@query(
    "P4_url_parts",
    ctes(r"""
      SELECT url, host, path, pretty, coalesce(nullif(pretty, ''), host) AS display_title FROM (
        SELECT url, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS host,
               regexp_replace(url, '^https?://[^/]+', '') AS path,
               array_to_string(list_transform(
                 string_split(regexp_replace(regexp_replace(coalesce(list_extract(list_filter(
                   string_split(regexp_replace(url, '^https?://[^/]+', ''), '/'), lambda s: s <> ''), -1), ''), '[-_]', ' ', 'g'),
                   '(^|[^A-Za-z0-9_])([a-z])', '\1' || chr(1) || '\2', 'g'), chr(1)),
                 lambda w, i: CASE WHEN i = 1 THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), '') AS pretty
        FROM (SELECT url FROM pages UNION ALL SELECT url FROM listings))"""),
)
def url_parts(spark, d):
    urls = derive.given(spark, d, "pages").select("url").unionByName(derive.listings(spark, d).select("url"))
    shown = corpus.display_title(
        corpus.url_parts(urls)
        .withColumn("doc_type", F.lit("article"))
        .withColumn("filename", F.lit(None).cast("string"))
        .withColumn("location", F.lit(None).cast("string"))
    )
    return shown.select("url", "host", "path", "pretty", "display_title")


@query(
    "P5_dedup_by_content",
    ctes("""SELECT doc_no, url, sha256(body) AS content_hash FROM bodies
            QUALIFY row_number() OVER (PARTITION BY sha256(body) ORDER BY doc_no) = 1"""),
)
def dedup_by_content(spark, d):
    docs = corpus.normalize(derive.corpus(spark, d)).select(
        "doc_no", "url", keys.content_hash(F.col("body")).alias("content_hash")
    )
    return corpus.dedup_by_content(docs, ["content_hash"], ["doc_no"])


# ---- text ------------------------------------------------------------------


@query(
    "P6_normalize_text",
    f"SELECT doc_id, {sqlkit.normalize('text')} AS body FROM documents UNION ALL SELECT -1 - page_id, {sqlkit.normalize('html')} FROM pages",
)
def normalize_text(spark, d):
    docs = derive.given(spark, d, "documents").select("doc_id", "text")
    pages = derive.given(spark, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    return corpus.normalize(docs.unionByName(pages), "text").select("doc_id", "body")


@query(
    "P7_split_sections",
    f"""SELECT page_id, ord, section FROM (
          SELECT page_id, unnest(parts) AS section, unnest(range(len(parts))) AS ord FROM (
            SELECT page_id, {sqlkit.pieces(rf"string_split(regexp_replace({_sql_markdown('html')}, '(?m)^(#{{1,6}}[{sqlkit.BLANK}]+.)', chr(1) || '\1', 'g'), chr(1))")} AS parts FROM pages))""",
)
def split_sections(spark, d):
    pages = derive.given(spark, d, "pages").select("page_id", corpus_source.page_markdown(F.col("html")).alias("body"))
    return flat(corpus.split_into(pages, tx.sections(F.col("body")), "ord", "section").drop("body"))


@query("P8_split_paragraphs", ctes("SELECT doc_no, chunk_index AS ord, content AS paragraph FROM chunks"))
def split_paragraphs(spark, d):
    body = corpus.normalize(derive.corpus(spark, d)).select("doc_no", "body")
    return flat(corpus.split_into(body, tx.paragraphs(F.col("body")), "ord", "paragraph").drop("body"))


@query(
    "P9_split_sentences",
    f"""SELECT doc_id, ord, sentence FROM (
          SELECT doc_id, unnest(parts) AS sentence, unnest(range(len(parts))) AS ord
          FROM (SELECT doc_id, {sqlkit.sentences('text')} AS parts FROM documents))""",
)
def split_sentences(spark, d):
    docs = derive.given(spark, d, "documents").select("doc_id", "text")
    return flat(corpus.split_into(docs, tx.sentences(F.col("text")), "ord", "sentence").drop("text"))


@query(
    "P10_hard_slices",
    ctes("""SELECT doc_no, unnest(range(len(cuts))) AS ord, unnest(cuts) AS cut FROM (
              SELECT doc_no, list_transform(range(0, length(body), 1200), lambda i: substr(body, i + 1, 1200)) AS cuts FROM bodies WHERE body <> '')"""),
)
def hard_slices(spark, d):
    body = corpus.normalize(derive.corpus(spark, d)).select("doc_no", "body").filter("body <> ''")
    return flat(corpus.split_into(body, chunking.slices(F.col("body"), 1200), "ord", "cut").drop("body"))


# The splitter as a walk over units; the SQL does one unit of every document per
# step. Long paragraphs are first packed the same way from sentences and slices.
_LEAD = rf"""(CASE WHEN length(done) <= 180 THEN done ELSE
    CASE WHEN regexp_extract(right(done, 180), '(?s)[.!?]\s+(.+)\z', 1) <> '' THEN {sqlkit.trim_blank(r"regexp_extract(right(done, 180), '(?s)[.!?]\s+(.+)\z', 1)")}
         WHEN regexp_extract(right(done, 180), '(?s)\s+(\S.*)\z', 1) <> '' THEN {sqlkit.trim_blank(r"regexp_extract(right(done, 180), '(?s)\s+(\S.*)\z', 1)")}
         ELSE {sqlkit.trim_blank('right(done, 180)')} END END)"""


def sql_chunks(source: str, key: str) -> str:
    """CTE chain ending in ``packed`` (key, chunk_index, content) for a relation
    with ``key`` and normalised ``body``."""
    units = sqlkit.paragraphs("section")
    return rf"""
    WITH RECURSIVE paras AS MATERIALIZED (
      SELECT {key}, sno, unnest(parts) AS para, unnest(range(len(parts))) AS pno FROM (
        SELECT {key}, sno, {units} AS parts FROM (
          SELECT {key}, unnest(parts) AS section, unnest(range(len(parts))) AS sno FROM (
            SELECT {key}, {sqlkit.pieces(rf"string_split(regexp_replace(body, '(?m)^(#{{1,6}}[{sqlkit.BLANK}]+.)', chr(1) || '\1', 'g'), chr(1))")} AS parts FROM {source})))),
    sents AS MATERIALIZED (
      SELECT {key}, sno, pno, row_number() OVER (PARTITION BY {key}, sno, pno ORDER BY ord, cno) AS n, piece, giant FROM (
        SELECT {key}, sno, pno, ord, unnest(cuts) AS piece, unnest(range(len(cuts))) AS cno, giant FROM (
          SELECT {key}, sno, pno, ord, length(s) > 1200 AS giant,
                 list_transform(range(0, length(s), 1200), lambda i: substr(s, i + 1, 1200)) AS cuts FROM (
            SELECT {key}, sno, pno, unnest(ss) AS s, unnest(range(len(ss))) AS ord
            FROM (SELECT {key}, sno, pno, {sqlkit.sentences('para')} AS ss FROM paras WHERE length(para) > 1200))))),
    walk AS (
      SELECT {key}, sno, pno, n, piece AS buf, giant, 1 AS unit FROM sents WHERE n = 1
      UNION ALL
      SELECT w.{key}, w.sno, w.pno, s.n,
             CASE WHEN NOT s.giant AND NOT w.giant AND length(w.buf) + 1 + length(s.piece) <= 1200 THEN w.buf || ' ' || s.piece ELSE s.piece END,
             s.giant,
             CASE WHEN NOT s.giant AND NOT w.giant AND length(w.buf) + 1 + length(s.piece) <= 1200 THEN w.unit ELSE w.unit + 1 END
      FROM walk w JOIN sents s ON s.{key} = w.{key} AND s.sno = w.sno AND s.pno = w.pno AND s.n = w.n + 1),
    units AS MATERIALIZED (
      SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY sno, pno, unit) AS n, u FROM (
        SELECT {key}, sno, pno, 0 AS unit, para AS u FROM paras WHERE length(para) <= 1200
        UNION ALL SELECT {key}, sno, pno, unit, arg_max(buf, n) FROM walk GROUP BY {key}, sno, pno, unit)),
    pack AS (
      SELECT {key}, n, u AS cur, 0::BIGINT AS chunk FROM units WHERE n = 1
      UNION ALL
      SELECT {key}, n,
        CASE WHEN length(grown) <= 1200 THEN grown
             WHEN length({_LEAD} || chr(10) || chr(10) || u) <= 1200 THEN {_LEAD} || chr(10) || chr(10) || u ELSE u END,
        CASE WHEN length(grown) <= 1200 THEN chunk ELSE chunk + 1 END
      FROM (SELECT p.{key}, x.n, x.u, p.chunk, p.cur || chr(10) || chr(10) || x.u AS grown, {sqlkit.trim_blank('p.cur')} AS done
            FROM pack p JOIN units x ON x.{key} = p.{key} AND x.n = p.n + 1)),
    closed AS MATERIALIZED (
      SELECT {key}, chunk, {sqlkit.trim_blank('arg_max(cur, n)')} AS content, max(chunk) OVER (PARTITION BY {key}) AS last
      FROM pack GROUP BY {key}, chunk),
    packed AS (
      SELECT a.{key}, a.chunk AS chunk_index, a.content || coalesce(chr(10) || chr(10) || b.content, '') AS content
      FROM closed a LEFT JOIN closed b ON b.{key} = a.{key} AND b.chunk = a.chunk + 1 AND b.chunk = b.last
        AND length(b.content) < 200 AND length(a.content) + 2 + length(b.content) <= 1200
      WHERE NOT (a.chunk = a.last AND a.chunk > 0 AND length(a.content) < 200 AND EXISTS (
        SELECT 1 FROM closed p WHERE p.{key} = a.{key} AND p.chunk = a.chunk - 1 AND length(p.content) + 2 + length(a.content) <= 1200)))
    """


@query(
    "P11_P12_P13_chunk_text",
    ctes(sql_chunks("bodies", "doc_no") + "SELECT doc_no, chunk_index, content FROM packed"),
)
def chunk_text(spark, d):
    body = corpus.normalize(derive.corpus(spark, d)).select("doc_no", "body")
    return flat(chunking.explode_chunks(body, chunking.chunk_text(F.col("body"))).drop("body"))


@query(
    "P14_chunk_documents",
    ctes(
        sql_chunks("bodies", "doc_no")
        + """SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars, min(sha256(content)) AS first_hash FROM (
               SELECT b.doc_id, p.content FROM packed p JOIN bodies b USING (doc_no)
               UNION ALL SELECT doc_id, """
        + sqlkit.normalize("markdown")
        + " FROM listings) GROUP BY doc_id"
    ),
)
def chunk_documents(spark, d):
    columns = ["doc_id", "url", "title", "markdown", "doc_type", "language"]
    records = derive.corpus(spark, d).select(*columns).unionByName(derive.listings(spark, d).select(*columns))
    chunks = corpus.chunk_documents(corpus.prepare_documents(records))
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.length("content")).alias("chars"),
        F.min("content_hash").alias("first_hash"),
    )


def _pages_of(spark, d):
    """Every paragraph of a document is a page of text."""
    chunks = derive.paragraph_chunks(spark, d)
    return chunks.select("doc_id", (F.col("chunk_index") + 1).alias("page"), F.col("content").alias("text"))


@query(
    "P15_chunk_pages",
    ctes(
        "WITH RECURSIVE page_bodies AS MATERIALIZED (SELECT chunk_id, "
        + sqlkit.normalize("content")
        + " AS body FROM chunks),"
        + sql_chunks("page_bodies", "chunk_id").lstrip()[len("WITH RECURSIVE") :]
        + """SELECT c.doc_id, c.chunk_index + 1 AS page, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.chunk_index, p.chunk_index) - 1 AS chunk_index, p.content
             FROM packed p JOIN chunks c USING (chunk_id) WHERE p.chunk_index < 20
               AND c.doc_id IN (SELECT doc_id FROM chunks GROUP BY doc_id HAVING count(*) <= 400 AND sum(length(content)) <= 500000)"""
    ),
)
def chunk_pages(spark, d):
    return flat(corpus.chunk_pages(_pages_of(spark, d)).select("doc_id", "page", "chunk_index", "content"))


def _long(col):
    """Session ids in the form that uploads demand."""
    return F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(col, 12, "0"))


def _files(spark, d):
    """Private documents as files of two parts, the second sent twice; every ninth lacks it, every tenth comes from a stranger."""
    pages = derive.paragraph_chunks(spark, d).filter("session_id IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda p: p["content"])
    files = pages.groupBy("doc_no", "session_id").agg(F.concat(F.lit("%PDF-\f"), F.array_join(ordered, "\f")).cast("binary").alias("body"))
    digest, half = F.md5(F.col("doc_no").cast("string")), F.floor(F.octet_length("body") / 2).cast("int")
    name = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    part = F.explode(F.filter(F.array(F.lit(0), F.lit(1), F.lit(1)), lambda i: (i == 0) | (F.col("doc_no") % 9 != 0))).alias("part_index")
    owned = files.join(derive.sessions(spark, d).select("session_id", "user_id"), "session_id")
    sent = owned.select("doc_no", "session_id", "user_id", "body", half.alias("half"), F.concat_ws("-", *name).alias("upload_id"), part)
    return sent.select(
        "upload_id", _long("session_id").alias("session_id"), "part_index",
        F.when(F.col("doc_no") % 10 == 0, "stranger").otherwise(F.col("user_id")).alias("user_id"),
        F.lit(2).alias("total_parts"),
        F.concat(F.lit("file "), F.col("doc_no").cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(F.col("part_index") == 0, F.substring("body", F.lit(1), F.col("half")))
        .otherwise(F.substring("body", F.col("half") + 1, F.octet_length("body"))).alias("data"),
        derive.as_of().alias("created_at"),
    )


@query(
    "D5_P15_index_uploads",
    ctes(
        "WITH RECURSIVE page_bodies AS MATERIALIZED (SELECT chunk_id, "
        + sqlkit.normalize("content")
        + " AS body FROM chunks),"
        + sql_chunks("page_bodies", "chunk_id").lstrip()[len("WITH RECURSIVE") :]
        + """SELECT 'upload-' || substr(sha256('00000000-0000-0000-0000-' || lpad(c.session_id, 12, '0') || '::file ' || c.doc_no || '.pdf'), 1, 14) AS doc_id, c.chunk_index + 1 AS page,
               row_number() OVER (PARTITION BY c.doc_id ORDER BY c.chunk_index, p.chunk_index) - 1 AS chunk_index, sha256(p.content) AS content_hash,
               'file ' || c.doc_no || '.pdf' AS filename, s.user_id AS owner
             FROM packed p JOIN chunks c USING (chunk_id) JOIN sessions s USING (session_id)
             WHERE p.chunk_index < 20 AND c.doc_no % 9 <> 0 AND c.doc_no % 10 <> 0
               AND c.doc_id IN (SELECT doc_id FROM chunks GROUP BY doc_id HAVING count(*) <= 400 AND sum(length(content)) <= 500000)"""
    ),
)
def index_uploads(spark, d):
    """From parts of files to searchable chunks with page, file name and owner."""
    from corpusflow.operators.filters import with_owner
    from corpusflow.plans import ingest

    sessions = derive.sessions(spark, d).withColumn("session_id", _long("session_id"))
    found = with_owner(ingest.index_uploads(_files(spark, d), sessions).chunks, sessions)
    return flat(found.select("doc_id", "page", "chunk_index", "content_hash", "metadata.filename", "owner"))


@query(
    "P16_document_limits",
    ctes("""SELECT doc_id, count(*) AS total_pages, sum(length(content))::BIGINT AS total_chars,
              CASE WHEN count(*) > 400 THEN 'too_many_pages' WHEN sum(length(content)) > 500000 THEN 'too_many_chars' END AS reason
            FROM chunks GROUP BY doc_id"""),
)
def document_limits(spark, d):
    return flat(corpus.document_limits(_pages_of(spark, d)))


@query(
    "P17_hashes",
    ctes("""SELECT c.doc_id, c.chunk_index, sha256(c.content) AS content_hash, sha256(b.body) AS source_hash
            FROM chunks c JOIN bodies b USING (doc_no)"""),
)
def hashes(spark, d):
    docs = corpus.prepare_documents(derive.corpus(spark, d))
    pieces = corpus.split_into(docs, tx.paragraphs(F.col("body")), "chunk_index", "content")
    return flat(
        pieces.select("doc_id", "chunk_index", keys.content_hash(F.col("content")).alias("content_hash"), "source_hash")
    )


_PRICE = "(CASE p_size % 4 WHEN 1 THEN price ELSE price END)::DOUBLE"
LISTING_FACTS = """
  SELECT 'https://homes.example.com' || CASE p_partkey % 3 WHEN 0 THEN '/en/units/' WHEN 1 THEN '/az/menziller/' ELSE '/ru/kvartiry/' END
           || replace(p_name, ' ', '-') || '-' || p_partkey AS url,
         (round(p_retailprice * 1000))::DOUBLE AS price,
         CASE p_size % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'AZN' END AS currency,
         CASE WHEN p_partkey % 3 = 0 THEN (1 + p_size % 5)::BIGINT END AS bedrooms,
         CASE WHEN p_partkey % 3 <> 0 THEN (2 + p_size % 5)::BIGINT END AS total_rooms,
         CASE WHEN p_partkey % 3 <> 2 THEN (1 + p_size % 3)::BIGINT END AS bathrooms,
         (40 + p_size * 3)::DOUBLE AS area_sqm,
         CASE WHEN p_size % 2 = 1 THEN 'sale' ELSE 'rent' END AS listing_type,
         CASE p_size % 4 WHEN 0 THEN 'apartment' WHEN 1 THEN 'villa' WHEN 2 THEN 'office' ELSE 'retail' END AS property_type,
         n_name AS location
  FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25"""


@query(
    "P18_inherit_metadata",
    ctes(f"""SELECT l.doc_id, 0::BIGINT AS chunk_index, l.language, l.doc_type, f.price, f.bedrooms, f.location
             FROM listings l JOIN ({LISTING_FACTS}) f USING (url)
             UNION ALL SELECT doc_id, chunk_index, language, doc_type, NULL, NULL, NULL FROM chunks"""),
)
def inherit_metadata(spark, d):
    columns = ["doc_id", "url", "title", "markdown", "doc_type", "language"]
    records = derive.corpus(spark, d).select(*columns).unionByName(derive.listings(spark, d).select(*columns))
    docs = corpus.prepare_documents(records)
    pieces = F.when(F.col("doc_type") == "listing", F.array("body")).otherwise(tx.paragraphs(F.col("body")))
    chunks = corpus.split_into(docs, pieces, "chunk_index", "content")
    return flat(
        chunks.select(
            "doc_id", "chunk_index", "metadata.language", "metadata.doc_type", "metadata.price", "metadata.bedrooms",
            "metadata.location",
        )
    )


def _listing_text(spark, d):
    listing = derive.listings(spark, d)
    return listing.withColumn("body", F.concat("title", F.lit("\n"), "markdown"))


@query("P19_price", f"SELECT url, price, currency FROM ({LISTING_FACTS})")
def price(spark, d):
    found = _listing_text(spark, d).withColumn("money", facts.price(F.col("body")))
    return found.select("url", "money.price", "money.currency")


@query("P20_counts", f"SELECT url, bedrooms, total_rooms, bathrooms FROM ({LISTING_FACTS})")
def counts(spark, d):
    body = F.col("body")
    return flat(
        _listing_text(spark, d).select(
            "url",
            facts.bedrooms(body).alias("bedrooms"),
            facts.total_rooms(body).alias("total_rooms"),
            facts.bathrooms(body).alias("bathrooms"),
        )
    )


@query("P21_area", f"SELECT url, area_sqm FROM ({LISTING_FACTS})")
def area(spark, d):
    return _listing_text(spark, d).select("url", facts.area_sqm(F.col("body")).alias("area_sqm"))


@query("P22_types", f"SELECT url, listing_type, property_type, location FROM ({LISTING_FACTS})")
def types(spark, d):
    body = F.col("body")
    return _listing_text(spark, d).select(
        "url",
        facts.listing_type(body).alias("listing_type"),
        facts.property_type(body).alias("property_type"),
        facts.location(F.col("title")).alias("location"),
    )


@query(
    "P23_parse_number",
    """SELECT o_orderkey, round(o_totalprice * 100) / 100 AS dotted, floor(o_totalprice)::DOUBLE AS grouped, floor(o_totalprice)::DOUBLE AS blank_grouped
       FROM orders""",
)
def parse_numbers(spark, d):
    whole = F.floor("o_totalprice").cast("bigint")
    thousands = F.when(
        whole >= 1000, F.concat((F.floor(whole / 1000)).cast("string"), F.lit("{}"), F.lpad((whole % 1000).cast("string"), 3, "0"))
    ).otherwise(whole.cast("string"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    dotted = F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    return derive.given(spark, d, "orders").select(
        "o_orderkey",
        parse_number(dotted).alias("dotted"),
        parse_number(F.replace(thousands, F.lit("{}"), F.lit("."))).alias("grouped"),
        parse_number(F.replace(thousands, F.lit("{}"), F.lit(" "))).alias("blank_grouped"),
    )


@query(
    "P24_extract_facts",
    r"""SELECT doc_id, nullif(regexp_extract(text, '(?i)token\s*=\s*\x22([^\x22]+)\x22', 1), '') AS token,
               coalesce(nullif(regexp_extract(text, '([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)', 1), ''), nullif(regexp_extract(text, '([0-9]{16})', 1), '')) AS number,
               try_cast(nullif(regexp_extract(text, '([0-9]{1,9})', 1), '') AS BIGINT) AS first_count
        FROM documents""",
)
def extract_facts(spark, d):
    rules = [
        facts.Rule("token", '(?i)token\\s*=\\s*"([^"]+)"'),
        facts.Rule("number", "([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)"),
        facts.Rule("number", "([0-9]{16})"),
        facts.Rule("first_count", "([0-9]{1,9})", "bigint"),
    ]
    docs = derive.given(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", facts.extract_facts(F.col("text"), rules).alias("f")).select("doc_id", "f.*")


# ---- vectors ---------------------------------------------------------------


@query(
    "P25_embed_documents",
    ctes("SELECT chunk_id, unnest(range(len(vec))) AS dim, round(unnest(vec), 6) + 0.0 AS w FROM chunk_vectors"),
)
def embed_documents(spark, d):
    rows = derive.search_chunks(spark, d).select("chunk_id", F.posexplode("embedding").alias("dim", "w"))
    return flat(rows.withColumn("w", F.round(F.col("w").cast("double"), 6) + F.lit(0.0)))


@query(
    "P26_embed_queries",
    ctes("SELECT query_id, unnest(range(len(vec))) AS dim, round(unnest(vec), 6) + 0.0 AS w FROM query_vectors"),
)
def embed_queries(spark, d):
    rows = derive.asked(spark, d).select("query_id", F.posexplode("embedding").alias("dim", "w"))
    return flat(rows.withColumn("w", F.round(F.col("w").cast("double"), 6) + F.lit(0.0)))


@query("P27_check_dim", "SELECT vec_id, len(embedding) AS dim FROM embeddings WHERE len(embedding) = 64")
def check_dim(spark, d):
    vectors = derive.given(spark, d, "embeddings").select("vec_id", "embedding")
    return flat(encode.check_dim(vectors, 64).select("vec_id", F.size("embedding").alias("dim")))


@query(
    "P28_assemble_pages",
    ctes(f"SELECT doc_id, chunk_index + 1 AS page, {sqlkit.squeeze('content')} AS text FROM chunks"),
)
def assemble_pages(spark, d):
    words = F.split("content", " ")
    fragments = derive.paragraph_chunks(spark, d).select(
        "doc_id", (F.col("chunk_index") + 1).alias("page"), F.posexplode(words).alias("position", "str")
    )
    return flat(corpus.assemble_pages(fragments))
