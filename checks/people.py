"""User context, favourites and uploads (F, V, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derive
from checks.registry import flat, query
from checks.sqlkit import AS_OF, CTES, ctes, seconds
from corpusflow.operators import context, favorites, profile, uploads

# Uploads in the given data share one title per document, so titles repeat here.
CTES["uploaded"] = """
  SELECT c.*, s.user_id, s.title AS session_title, 'file ' || (doc_no % 7) AS file_title FROM corpus c JOIN sessions s USING (session_id) WHERE doc_type = 'upload'"""
CTES["counts"] = """
  SELECT user_id, count(*) FILTER (k = 'm') AS memory_n, count(*) FILTER (k = 'f') AS favorite_n, count(*) FILTER (k = 'u') AS upload_n
  FROM (SELECT user_id, 'm' AS k FROM memory UNION ALL SELECT user_id, 'f' FROM favorites UNION ALL SELECT user_id, 'u' FROM uploaded) GROUP BY user_id"""
CTES["fav8"] = """
  SELECT f.user_id, f.note, d.title, d.url, row_number() OVER (PARTITION BY f.user_id ORDER BY f.created_at DESC, f.id) AS position
  FROM favorites f JOIN docs d USING (doc_id) QUALIFY position <= 8"""
CTES["topics8"] = """
  SELECT user_id, position, question AS topic FROM (
    SELECT user_id, question, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position FROM memory QUALIFY position <= 8)"""
CTES["uploads6"] = """
  SELECT user_id, title, doc_id, total_pages, row_number() OVER (PARTITION BY user_id ORDER BY title) AS position FROM (
    SELECT user_id, file_title AS title, doc_id, total_pages FROM uploaded
    QUALIFY row_number() OVER (PARTITION BY user_id, file_title ORDER BY updated_at DESC, doc_id DESC) = 1) QUALIFY position <= 6"""


def _docs(spark, d):
    """Documents with repeating file titles for uploads."""
    return derive.documents(spark, d).withColumn(
        "title",
        F.when(F.col("doc_type") == "upload", F.concat(F.lit("file "), (F.col("doc_no") % 7).cast("string"))).otherwise(F.col("title")),
    )


def _context(spark, d):
    # Favourites use the short document key, uploads the hashed one; titles of
    # favourites come from the untouched documents.
    both = _docs(spark, d).filter("doc_type = 'upload'").unionByName(
        derive.documents_by_no(spark, d).withColumn("doc_type", F.lit("article"))
    )
    return profile.user_context(
        derive.sessions(spark, d), both, derive.favorites(spark, d), derive.memory(spark, d), derive.profiles(spark, d)
    )


@query("F1_recent_favorites", ctes("SELECT user_id, position, title, url, note FROM fav8"))
def recent_favorites(spark, d):
    got = profile.recent_favorites(derive.favorites(spark, d), derive.documents_by_no(spark, d))
    return flat(got.select("user_id", "position", "title", "url", "note"))


@query("F1_recent_topics", ctes("SELECT user_id, position, topic FROM topics8"))
def recent_topics(spark, d):
    return flat(profile.recent_topics(derive.memory(spark, d)))


@query(
    "F1_user_context",
    ctes("""SELECT user_id, summary, coalesce(memory_n, 0) AS memory_n, coalesce(favorite_n, 0) AS favorite_n, coalesce(upload_n, 0) AS upload_n,
              coalesce(f.titles, '') AS favorites, coalesce(t.topics, '') AS topics, coalesce(u.files, '') AS uploads
            FROM counts c FULL JOIN profiles p USING (user_id)
            LEFT JOIN (SELECT user_id, string_agg(title, '|' ORDER BY position) AS titles FROM fav8 GROUP BY 1) f USING (user_id)
            LEFT JOIN (SELECT user_id, string_agg(topic, '|' ORDER BY position) AS topics FROM topics8 GROUP BY 1) t USING (user_id)
            LEFT JOIN (SELECT user_id, string_agg(title || ':' || total_pages, '|' ORDER BY position) AS files FROM uploads6 GROUP BY 1) u USING (user_id)"""),
)
def user_context(spark, d):
    ctx = _context(spark, d)
    files = F.transform("uploads", lambda u: F.concat(u["title"], F.lit(":"), u["total_pages"].cast("string")))
    return ctx.select(
        "user_id", "summary", "memory_n", "favorite_n", "upload_n",
        F.array_join(F.transform("favorites", lambda f: f["title"]), "|").alias("favorites"),
        F.array_join("topics", "|").alias("topics"),
        F.array_join(files, "|").alias("uploads"),
    )


# Every other first sentence asks about a document as a whole.
_WHOLE = """
  SELECT query_id, CASE WHEN query_id % 2000 = 0 THEN 'Summarize this document: ' || text ELSE text END AS text, user_id, session_id FROM questions"""


@query(
    "R25_ask_batch",
    ctes(f"""WITH asked AS MATERIALIZED ({_WHOLE}),
      held AS MATERIALIZED (SELECT DISTINCT session_id AS k FROM chunks WHERE session_id IS NOT NULL UNION SELECT DISTINCT owner FROM owned WHERE owner IS NOT NULL)
      SELECT query_id, query_id % 2000 = 0 AND (session_id IN (SELECT k FROM held) OR coalesce(user_id IN (SELECT k FROM held), false)) AS whole_document,
             contains(text, 'Summarize this document: ') AS has_lead FROM asked"""),
)
def ask_batch(spark, d):
    """One model input per question, whole-document questions from document slices."""
    from corpusflow.plans import answer
    from corpusflow.session import settled, written

    q = F.col("query_id")
    questions = derive.questions(spark, d).withColumn(
        "text", F.when(q % 2000 == 0, F.concat(F.lit("Summarize this document: "), "text")).otherwise(F.col("text"))
    )
    sources, inputs, _ = answer.ask(
        settled(questions),
        written(derive.search_chunks(spark, d)),
        derive.sessions(spark, d),
        settled(derive.memory(spark, d, derive.DIM)),
        _context(spark, d),
        derive.as_of(),
    )
    # Slices carry the fixed score 1 and no word or vector score.
    whole = sources.groupBy("query_id").agg(
        F.bool_and((F.col("score") == 1.0) & (F.col("vector_score") == 0) & (F.col("rrf_score") == 0)).alias("whole_document")
    )
    lead = F.contains("prompt", F.lit("Question: Summarize this document: "))
    return inputs.join(whole, "query_id").select("query_id", "whole_document", lead.alias("has_lead"))


@query("F2_distinct_on", ctes("SELECT user_id, position, title, doc_id, total_pages FROM uploads6"))
def distinct_on(spark, d):
    got = profile.recent_uploads(_docs(spark, d), derive.sessions(spark, d))
    return flat(got.select("user_id", "position", "title", "doc_id", "total_pages"))


@query("F3_signal_counts", ctes("SELECT user_id, memory_n, favorite_n, upload_n FROM counts"))
def signal_counts(spark, d):
    return profile.signal_counts(
        derive.memory(spark, d), derive.favorites(spark, d), derive.documents(spark, d), derive.sessions(spark, d)
    )


_DECISION = f"""
  SELECT user_id, delta, CASE WHEN total = 0 THEN 'no_signals' WHEN delta = 0 THEN 'no_change'
    WHEN delta < 3 AND refreshed_at IS NOT NULL AND epoch_us({AS_OF}) - epoch_us(refreshed_at) < 60000000 THEN 'throttled' ELSE 'refresh' END AS decision
  FROM (SELECT user_id, refreshed_at, coalesce(memory_n, 0) + coalesce(favorite_n, 0) + coalesce(upload_n, 0) AS total,
          abs(coalesce(memory_n, 0) - coalesce(basis_memory_n, 0)) + abs(coalesce(favorite_n, 0) - coalesce(basis_favorite_n, 0))
          + abs(coalesce(upload_n, 0) - coalesce(basis_upload_n, 0)) AS delta FROM counts FULL JOIN profiles USING (user_id))"""


@query("F4_profile_decision", ctes(_DECISION))
def profile_decision(spark, d):
    counts = profile.signal_counts(
        derive.memory(spark, d), derive.favorites(spark, d), derive.documents(spark, d), derive.sessions(spark, d)
    )
    return profile.profile_decision(counts, derive.profiles(spark, d), derive.as_of())


# Profiles near the present counts, so that every decision occurs.
_NEAR = f"""
  SELECT user_id, memory_n - hash_n % 2 AS basis_memory_n, favorite_n - hash_n % 5 AS basis_favorite_n, upload_n AS basis_upload_n,
         {AS_OF} - to_seconds(substr(user_id, 2)::BIGINT * 7) AS refreshed_at
  FROM (SELECT *, substr(user_id, 2)::BIGINT AS hash_n FROM counts WHERE user_id <> 'u4')"""


@query(
    "F4_decision_near_basis",
    ctes(_DECISION.replace("FULL JOIN profiles", f"FULL JOIN ({_NEAR})")),
)
def decision_near_basis(spark, d):
    counts = profile.signal_counts(
        derive.memory(spark, d), derive.favorites(spark, d), derive.documents(spark, d), derive.sessions(spark, d)
    )
    n = F.substring("user_id", 2, 10).cast("bigint")
    near = counts.filter("user_id <> 'u4'").select(
        "user_id",
        (F.col("memory_n") - n % 2).alias("basis_memory_n"),
        (F.col("favorite_n") - n % 5).alias("basis_favorite_n"),
        F.col("upload_n").alias("basis_upload_n"),
        F.timestamp_seconds(F.unix_timestamp(derive.as_of()) - n * 7).alias("refreshed_at"),
    )
    return profile.profile_decision(counts, near, derive.as_of())


@query(
    "F5_profile_text",
    ctes("""SELECT user_id, 'Signals collected (' || coalesce(memory_n, 0) || ' prior grounded Q&A, ' || coalesce(favorite_n, 0) || ' saved listings, '
              || coalesce(upload_n, 0) || ' uploaded docs):' || chr(10) || chr(10)
              || coalesce('Saved listings:' || chr(10) || f.x || chr(10) || chr(10), '')
              || coalesce('Recent questions (most recent first):' || chr(10) || t.x || chr(10) || chr(10), '')
              || coalesce('Uploaded documents:' || chr(10) || u.x || chr(10) || chr(10), '') || 'Write the intent profile now.' AS profile_text
            FROM counts FULL JOIN profiles USING (user_id)
            LEFT JOIN (SELECT user_id, string_agg('- ' || title || coalesce(' (note: ' || note || ')', ''), chr(10) ORDER BY position) AS x FROM fav8 GROUP BY 1) f USING (user_id)
            LEFT JOIN (SELECT user_id, string_agg('- ' || substr(topic, 1, 160), chr(10) ORDER BY position) AS x FROM topics8 GROUP BY 1) t USING (user_id)
            LEFT JOIN (SELECT user_id, string_agg('- ' || title || ' (' || total_pages || ' pages)', chr(10) ORDER BY position) AS x FROM uploads6 GROUP BY 1) u USING (user_id)"""),
)
def profile_text(spark, d):
    return profile.profile_text(_context(spark, d))


@query(
    "S11_profile_block",
    ctes(f"""SELECT user_id, CASE WHEN summary IS NULL AND f.x IS NULL AND t.x IS NULL AND u.x IS NULL THEN '' ELSE
              concat_ws(chr(10), '{context.PROFILE_HEADER}', 'Intent: ' || summary, 'Saved listings (' || coalesce(favorite_n, 0) || '): ' || f.x,
                'Recent topics:' || chr(10) || t.x, 'Uploaded docs: ' || u.x) END AS profile_block
            FROM counts FULL JOIN profiles USING (user_id)
            LEFT JOIN (SELECT user_id, string_agg(title, ' · ' ORDER BY position) AS x FROM fav8 GROUP BY 1) f USING (user_id)
            LEFT JOIN (SELECT user_id, string_agg('  - ' || substr(topic, 1, 140), chr(10) ORDER BY position) AS x FROM topics8 WHERE position <= 5 GROUP BY 1) t USING (user_id)
            LEFT JOIN (SELECT user_id, string_agg(title || ' (' || total_pages || 'p)', ' · ' ORDER BY position) AS x FROM uploads6 WHERE position <= 5 GROUP BY 1) u USING (user_id)"""),
)
def profile_block(spark, d):
    return context.profile_block(_context(spark, d))


@query(
    "F6_upsert_profiles",
    ctes(f"""SELECT user_id, CASE WHEN c.user_id IS NOT NULL THEN 'Wants ' || memory_n || ' things' ELSE p.summary END AS summary,
              coalesce(memory_n, basis_memory_n) AS basis_memory_n, coalesce(upload_n, basis_upload_n) AS basis_upload_n,
              CASE WHEN c.user_id IS NOT NULL THEN {seconds(AS_OF)} ELSE {seconds('refreshed_at')} END AS refreshed_at
             FROM profiles p FULL JOIN counts c USING (user_id)"""),
)
def upsert_profiles(spark, d):
    counts = profile.signal_counts(
        derive.memory(spark, d), derive.favorites(spark, d), derive.documents(spark, d), derive.sessions(spark, d)
    )
    summaries = counts.select(
        "user_id", F.concat(F.lit("  Wants  "), F.col("memory_n").cast("string"), F.lit("  things ")).alias("summary")
    )
    merged = profile.upsert_profiles(derive.profiles(spark, d), summaries, counts, derive.as_of())
    return flat(merged.select("user_id", "summary", "basis_memory_n", "basis_upload_n", "refreshed_at"))


@query(
    "F6_clear_profiles",
    ctes("SELECT user_id, summary FROM profiles WHERE user_id NOT IN (SELECT user_id FROM favorites)"),
)
def clear_profiles(spark, d):
    left = profile.clear_profiles(derive.profiles(spark, d), derive.favorites(spark, d).select("user_id"))
    return left.select("user_id", "summary")


# ---- favourites ------------------------------------------------------------


@query(
    "V1_list_favorites",
    ctes("""SELECT f.id, f.user_id, f.doc_id, f.note, d.title, d.language, row_number() OVER (PARTITION BY f.user_id ORDER BY f.created_at DESC, f.id) AS position
            FROM favorites f JOIN docs d USING (doc_id) QUALIFY position <= 500"""),
)
def list_favorites(spark, d):
    got = favorites.list_favorites(derive.favorites(spark, d), derive.documents_by_no(spark, d))
    return flat(got.select("id", "user_id", "doc_id", "note", "title", "language", "position"))


@query("V2_is_favorite", ctes("SELECT doc_id, doc_id IN (SELECT doc_id FROM favorites WHERE user_id = 'u5') AS is_favorite FROM docs"))
def is_favorite(spark, d):
    marked = favorites.mark_favorites(derive.documents_by_no(spark, d), derive.favorites(spark, d), "u5")
    return marked.select("doc_id", "is_favorite")


_SAVED = """
  SELECT user_id, doc_id, min(id) AS id, arg_max(note, created_at) FILTER (note IS NOT NULL) AS note, {} AS created_at
  FROM saves WHERE doc_id IN (SELECT doc_id FROM docs) GROUP BY user_id, doc_id"""


@query(
    "V3_add_favorites",
    ctes(f"SELECT id, user_id, doc_id, note, created_at FROM ({_SAVED.format(seconds('min(created_at)'))})"),
)
def add_favorites(spark, d):
    saves = derive.saves(spark, d).drop("doc_no")
    merged, _ = favorites.add_favorites(saves.filter("false"), derive.documents_by_no(spark, d), saves)
    return flat(merged.select("id", "user_id", "doc_id", "note", "created_at"))


@query(
    "V3_add_again",
    ctes(f"""SELECT f.id, f.user_id, f.doc_id, coalesce(s.note, f.note) AS note, {seconds('f.created_at')} AS created_at
             FROM favorites f JOIN ({_SAVED.format('min(created_at)')}) s USING (user_id, doc_id)"""),
)
def add_again(spark, d):
    """Saving everything once more changes notes only."""
    merged, _ = favorites.add_favorites(
        derive.favorites(spark, d), derive.documents_by_no(spark, d), derive.saves(spark, d).drop("doc_no")
    )
    return flat(merged.select("id", "user_id", "doc_id", "note", "created_at"))


@query("V3_rejected", ctes("SELECT id, user_id, doc_id FROM saves WHERE doc_id NOT IN (SELECT doc_id FROM docs)"))
def rejected(spark, d):
    saves = derive.saves(spark, d).drop("doc_no")
    _, bad = favorites.add_favorites(saves.filter("false"), derive.documents_by_no(spark, d), saves)
    return bad.select("id", "user_id", "doc_id")


@query(
    "V4_remove_favorites",
    ctes("SELECT id, user_id, doc_id FROM favorites f WHERE (user_id, doc_id) NOT IN (SELECT user_id, doc_id FROM saves WHERE note IS NULL)"),
)
def remove_favorites(spark, d):
    gone = derive.saves(spark, d).filter("note IS NULL").select("user_id", "doc_id")
    return favorites.remove_favorites(derive.favorites(spark, d), gone, by="doc_id").select("id", "user_id", "doc_id")


@query(
    "V4_update_notes",
    ctes("SELECT f.id, f.user_id, CASE WHEN f.note IS NULL THEN 'edited ' || f.doc_id ELSE f.note END AS note FROM favorites f"),
)
def update_notes(spark, d):
    saved = derive.favorites(spark, d)
    own = saved.filter("note IS NULL").select("id", "user_id", F.concat(F.lit("edited "), "doc_id").alias("note"))
    foreign = saved.filter("note IS NOT NULL").select("id", F.lit("intruder").alias("user_id"), F.lit("x").alias("note"))
    return favorites.update_notes(saved, own.unionByName(foreign)).select("id", "user_id", "note")


@query("V5_favorites_stats", ctes(f"SELECT user_id, count(*) AS total, {seconds('max(created_at)')} AS newest FROM favorites GROUP BY user_id"))
def favorites_stats(spark, d):
    return flat(favorites.favorites_stats(derive.favorites(spark, d)))


# ---- uploads ---------------------------------------------------------------


@query(
    "D1_list_uploads",
    ctes("""SELECT d.session_id, d.doc_id, d.title, count(c.chunk_id) AS chunk_count,
              row_number() OVER (PARTITION BY d.session_id ORDER BY d.updated_at DESC, d.doc_id) AS position
            FROM corpus d LEFT JOIN chunks c ON c.doc_id = d.doc_id AND c.session_id = d.session_id WHERE d.doc_type = 'upload'
            GROUP BY d.session_id, d.doc_id, d.title, d.updated_at QUALIFY position <= 50"""),
)
def list_uploads(spark, d):
    got = uploads.list_uploads(derive.documents(spark, d), derive.paragraph_chunks(spark, d))
    return flat(got.select("session_id", "doc_id", "title", "chunk_count", "position"))


_LIBRARY = """
  SELECT user_id, d.doc_id, d.title, session_title, (SELECT count(*) FROM chunks c WHERE c.doc_id = d.doc_id AND c.session_id = d.session_id) AS chunk_count,
    size_kb, row_number() OVER (PARTITION BY user_id ORDER BY d.updated_at DESC, d.doc_id) AS position FROM uploaded d QUALIFY position <= 200"""


def _library(spark, d):
    return uploads.upload_library(
        derive.documents(spark, d), derive.sessions(spark, d), derive.paragraph_chunks(spark, d)
    )


@query("D2_upload_library", ctes(_LIBRARY))
def upload_library(spark, d):
    return flat(
        _library(spark, d).select("user_id", "doc_id", "title", "session_title", "chunk_count", "size_kb", "position")
    )


@query(
    "D3_delete_uploads",
    ctes("""SELECT 'documents' AS name, count(*) AS rows FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM uploaded WHERE user_id = 'u2' AND size_kb >= 2)
            UNION ALL SELECT 'rag_chunks', count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM uploaded WHERE user_id = 'u2' AND size_kb >= 2)"""),
)
def delete_uploads(spark, d):
    docs = derive.documents(spark, d)
    tables = {
        "documents": docs,
        "rag_chunks": derive.paragraph_chunks(spark, d).select("chunk_id", "doc_id", "session_id"),
        "sessions": derive.sessions(spark, d),
    }
    gone = docs.filter("doc_type = 'upload' AND size_kb >= 2").select("doc_id", "session_id")
    left = uploads.delete_uploads(tables, gone, "u2")
    out = None
    for name in ("documents", "rag_chunks"):
        row = left[name].groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "D4_library_totals",
    ctes(f"SELECT user_id, count(*) AS documents, sum(chunk_count)::BIGINT AS chunks, sum(size_kb)::BIGINT AS size_kb FROM ({_LIBRARY}) GROUP BY user_id"),
)
def library_totals(spark, d):
    return uploads.library_totals(_library(spark, d))


CTES["part_reasons"] = """
  SELECT *, CASE WHEN NOT regexp_matches(upload_id, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN 'upload_id_not_uuid'
    WHEN part_index < 0 THEN 'part_index_negative' WHEN total_parts < 1 OR total_parts > 32 THEN 'total_parts_out_of_range'
    WHEN part_index >= total_parts THEN 'part_index_out_of_range' WHEN NOT lower(filename) LIKE '%.pdf' THEN 'filename_not_pdf'
    WHEN data = '' THEN 'part_empty' END AS reason FROM parts"""
CTES["first_parts"] = """
  SELECT * FROM part_reasons WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY upload_id, user_id, part_index ORDER BY created_at) = 1"""
CTES["upload_states"] = """
  SELECT *, CASE WHEN have < total_parts THEN 'incomplete' WHEN NOT starts_with(body, '%PDF-') THEN 'not_pdf' ELSE 'complete' END AS status FROM (
    SELECT upload_id, user_id, min(filename) AS filename, count(*) AS have, max(total_parts) AS total_parts, sum(octet_length(encode(data)))::BIGINT AS total_bytes,
           string_agg(data, '' ORDER BY part_index) AS body FROM first_parts GROUP BY upload_id, user_id)"""


def _valid_parts(spark, d):
    return uploads.validate_parts(derive.upload_parts(spark, d)).filter("reason IS NULL").drop("reason")


@query(
    "D5_assemble_uploads",
    ctes("SELECT upload_id, user_id, filename, have, total_parts, total_bytes, status, CASE WHEN status = 'complete' THEN body END AS body FROM upload_states"),
)
def assemble_uploads(spark, d):
    done = uploads.assemble_uploads(_valid_parts(spark, d))
    return flat(done.withColumn("body", F.col("data").cast("string")).drop("data"))


@query("D6_validate_parts", ctes("SELECT upload_id, part_index, coalesce(reason, 'ok') AS reason, count(*) AS parts FROM part_reasons GROUP BY 1, 2, 3"))
def validate_parts(spark, d):
    judged = uploads.validate_parts(derive.upload_parts(spark, d)).withColumn("reason", F.coalesce("reason", F.lit("ok")))
    return flat(judged.groupBy("upload_id", "part_index", "reason").agg(F.count(F.lit(1)).alias("parts")))


@query(
    "D7_purge_stale",
    ctes(f"SELECT upload_id, part_index, {seconds('created_at')} AS created_at FROM parts WHERE created_at >= TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR"),
)
def purge_stale(spark, d):
    left = uploads.purge_stale(derive.upload_parts(spark, d), F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    return flat(left.select("upload_id", "part_index", "created_at"))
