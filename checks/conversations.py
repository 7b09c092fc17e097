"""Sessions, messages, history and memory (S, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derive, sqlkit
from checks.derive import DIM
from checks.registry import flat, query
from checks.sqlkit import AS_OF, CTES, ctes, seconds, similarity, truncate
from corpusflow.operators import context, encode, load, memory, sessions

CTES["decided"] = rf"""
  SELECT *, CASE
    WHEN qq = '' OR aa = '' THEN 'empty' WHEN length(qq) < 8 THEN 'question_too_short'
    WHEN regexp_matches(qq, '{memory.CHITCHAT.replace('(?iu)', '(?i)')}') THEN 'chitchat'
    WHEN length(aa) < 80 THEN 'answer_too_short'
    WHEN regexp_matches(substr(aa, 1, 500), '{sqlkit.word('|'.join(memory.REFUSALS).replace("'", "''"), open_end=True)}') THEN 'refusal'
    WHEN NOT regexp_matches(aa, '\[S\d+\]') THEN 'no_citations' ELSE 'ok' END AS reason
  FROM (SELECT *, {sqlkit.trim_blank("coalesce(question, '')")} AS qq, {sqlkit.trim_blank("coalesce(answer, '')")} AS aa FROM pairs)"""
CTES["numbered"] = "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS back FROM messages"

# ---- sessions --------------------------------------------------------------


@query("S1_derive_title", f"SELECT conv_id, turn, {sqlkit.title_of('text')} AS title FROM conversations")
def derive_title(spark, d):
    rows = derive.given(spark, d, "conversations")
    return rows.select("conv_id", "turn", sessions.derive_title(F.col("text")).alias("title"))


@query(
    "S2_list_sessions",
    ctes("""SELECT s.session_id, s.user_id, s.title, count(*) AS message_count, min_by(m.content, m.id) FILTER (role = 'user') AS first_question,
              row_number() OVER (PARTITION BY s.user_id ORDER BY s.updated_at DESC, s.session_id) AS position
            FROM sessions s JOIN messages m USING (session_id) GROUP BY s.session_id, s.user_id, s.title, s.updated_at QUALIFY position <= 100"""),
)
def list_sessions(spark, d):
    listed = sessions.list_sessions(derive.sessions(spark, d), derive.messages(spark, d))
    return flat(listed.select("session_id", "user_id", "title", "message_count", "first_question", "position"))


def _renames(spark, d):
    """Every conversation asks for a name; one in three by somebody else."""
    conv = F.col("conv_id")
    user = F.when(conv % 3 == 0, "intruder").otherwise(F.concat(F.lit("u"), (conv % 20).cast("string")))
    first = derive.given(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select(
        conv.cast("string").alias("session_id"),
        user.alias("user_id"),
        F.when(conv % 7 == 0, "  ").otherwise(F.concat(F.lit(" Named  "), "text")).alias("title"),
    )


@query(
    "S4_rename_sessions",
    ctes(f"""SELECT s.session_id, CASE WHEN c.conv_id % 3 = 0 THEN s.title WHEN c.conv_id % 7 = 0 THEN NULL
               ELSE substr({sqlkit.squeeze("' Named  ' || c.text")}, 1, 200) END AS title,
               CASE WHEN c.conv_id % 3 = 0 THEN {seconds('s.updated_at')} ELSE {seconds(AS_OF)} END AS updated_at, {seconds('s.created_at')} AS created_at
             FROM sessions s JOIN (SELECT conv_id, min_by(text, turn) AS text FROM conversations GROUP BY conv_id) c ON c.conv_id::VARCHAR = s.session_id"""),
)
def rename_sessions(spark, d):
    renamed = sessions.rename_sessions(derive.sessions(spark, d), _renames(spark, d), derive.as_of())
    return flat(renamed.select("session_id", "title", "updated_at", "created_at"))


def _appended(spark, d):
    """All turns arrive on a store that knows the titled sessions and no message."""
    known = derive.sessions(spark, d).filter("title IS NOT NULL").withColumn(
        "title", F.when(F.col("session_id").cast("int") % 2 == 0, F.col("title"))
    )
    owners = derive.sessions(spark, d).select("session_id", "user_id")
    new = derive.messages(spark, d).join(owners, "session_id")
    return sessions.append_messages(known, derive.messages(spark, d).filter("false"), new)


@query(
    "S5_append_sessions",
    ctes(f"""SELECT s.session_id, s.user_id, coalesce(CASE WHEN s.session_id::INT % 2 = 0 THEN s.title END,
               (SELECT {sqlkit.title_of("min_by(m.content, m.id) FILTER (role = 'user')")} FROM messages m WHERE m.session_id = s.session_id)) AS title,
               {seconds('s.updated_at')} AS updated_at FROM sessions s"""),
)
def append_sessions(spark, d):
    merged, _ = _appended(spark, d)
    return flat(merged.select("session_id", "user_id", "title", "updated_at"))


@query("S5_append_messages", ctes("SELECT session_id, count(*) AS messages, max(id) AS last_id FROM messages GROUP BY session_id"))
def append_messages(spark, d):
    _, merged = _appended(spark, d)
    return merged.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.max("id").alias("last_id"))


@query(
    "S6_list_messages",
    ctes("""SELECT m.id, m.session_id, s.user_id, m.role, m.content FROM messages m JOIN sessions s USING (session_id)
            QUALIFY row_number() OVER (PARTITION BY m.session_id ORDER BY m.created_at, m.id) <= 3"""),
)
def list_messages(spark, d):
    listed = sessions.list_messages(derive.messages(spark, d), derive.sessions(spark, d), 3)
    return listed.select("id", "session_id", "user_id", "role", "content")


@query(
    "S7_recent_history",
    ctes("SELECT session_id, role, content, row_number() OVER (PARTITION BY session_id ORDER BY back DESC) AS position FROM numbered WHERE back <= 6"),
)
def recent_history(spark, d):
    return flat(sessions.recent_history(derive.messages(spark, d)).select("session_id", "role", "content", "position"))


@query(
    "S8_alternate_turns",
    ctes("""SELECT session_id, id, role FROM (
              SELECT *, lead(role) OVER (PARTITION BY session_id ORDER BY back DESC) AS later FROM (
                SELECT *, lag(role) OVER (PARTITION BY session_id ORDER BY back DESC) AS earlier FROM (
                  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS back
                  FROM (SELECT * REPLACE (CASE WHEN id % 1000 = 2 THEN 'assistant' ELSE role END AS role) FROM messages))
                WHERE back <= 6 AND trim(content) <> '')
              WHERE earlier IS NULL OR earlier <> role)
            WHERE role = 'assistant' OR later IS NOT NULL"""),
)
def alternate_turns(spark, d):
    # Third turns change their role, so equal roles stand next to each other.
    turns = derive.messages(spark, d).withColumn(
        "role", F.when(F.col("id") % 1000 == 2, "assistant").otherwise(F.col("role"))
    )
    return sessions.alternate_turns(sessions.recent_history(turns)).select("session_id", "id", "role")


def _tables(spark, d):
    return {
        "sessions": derive.sessions(spark, d),
        "messages": derive.messages(spark, d),
        "conversation_memory": derive.memory(spark, d),
        "documents": derive.documents(spark, d),
        "rag_chunks": derive.paragraph_chunks(spark, d).select("chunk_id", "doc_id", "session_id"),
        "favorites": derive.favorites(spark, d)
        .join(derive.documents_by_no(spark, d).select("doc_id", F.col("url")), "doc_id")
        .select("id", "user_id", F.substring(F.sha1("url"), 1, 16).alias("doc_id")),
    }


def _counts(tables):
    out = None
    for name, frame in tables.items():
        row = frame.groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


# Sessions of users u3 and u8 go; documents without text hash in the first half go.
_DEAD_SESSIONS = "(SELECT session_id FROM sessions WHERE user_id IN ('u3', 'u8'))"


@query(
    "S9_delete_sessions",
    ctes(f"""SELECT 'sessions' AS name, count(*) AS rows FROM sessions WHERE session_id NOT IN {_DEAD_SESSIONS}
      UNION ALL SELECT 'messages', count(*) FROM messages WHERE session_id NOT IN {_DEAD_SESSIONS}
      UNION ALL SELECT 'conversation_memory', count(*) FROM memory WHERE session_id NOT IN {_DEAD_SESSIONS}
      UNION ALL SELECT 'documents', count(*) FROM corpus WHERE session_id IS NULL OR session_id NOT IN {_DEAD_SESSIONS}
      UNION ALL SELECT 'rag_chunks', count(*) FROM chunks WHERE session_id IS NULL OR session_id NOT IN {_DEAD_SESSIONS}
      UNION ALL SELECT 'favorites', count(*) FROM favorites f JOIN docs x USING (doc_id) WHERE x.session_id IS NULL OR x.session_id NOT IN {_DEAD_SESSIONS}"""),
)
def delete_sessions(spark, d):
    gone = derive.sessions(spark, d).filter("user_id IN ('u3', 'u8')").select("session_id")
    return _counts(load.delete_cascade(_tables(spark, d), "session", gone))


@query(
    "S9_delete_documents",
    ctes("""SELECT 'sessions' AS name, count(*) AS rows FROM sessions UNION ALL SELECT 'messages', count(*) FROM messages
      UNION ALL SELECT 'conversation_memory', count(*) FROM memory
      UNION ALL SELECT 'documents', count(*) FROM corpus WHERE language <> 'fr'
      UNION ALL SELECT 'rag_chunks', count(*) FROM chunks WHERE language <> 'fr'
      UNION ALL SELECT 'favorites', count(*) FROM favorites f JOIN docs x USING (doc_id) WHERE x.language <> 'fr'"""),
)
def delete_documents(spark, d):
    gone = derive.documents(spark, d).filter("language = 'fr'").select("doc_id")
    return _counts(load.delete_cascade(_tables(spark, d), "document", gone))


@query(
    "S9_delete_messages",
    ctes("""SELECT id, session_id, CASE WHEN message_id IN (SELECT id FROM messages WHERE length(content) > 400) THEN NULL ELSE message_id END AS message_id FROM memory"""),
)
def delete_messages(spark, d):
    gone = derive.messages(spark, d).filter("length(content) > 400").select("id")
    left = load.delete_cascade(_tables(spark, d), "message", gone)
    return left["conversation_memory"].select("id", "session_id", "message_id")


@query(
    "S10_followup_context",
    ctes("""SELECT q.query_id, 'Conversation so far:' || chr(10) || t.transcript || chr(10) || chr(10) || 'Follow-up question: ' || q.text
              || chr(10) || chr(10) || 'Standalone search query:' AS rewrite_input
            FROM questions q JOIN (
              SELECT session_id, string_agg(CASE WHEN role = 'assistant' THEN 'Assistant' ELSE 'User' END || ': ' || content, chr(10) || chr(10) ORDER BY back DESC) AS transcript
              FROM numbered WHERE back <= 4 GROUP BY session_id) t USING (session_id)"""),
)
def followup_context(spark, d):
    return sessions.followup_context(derive.messages(spark, d), derive.questions(spark, d))


@query(
    "A3_session_activity",
    ctes(f"""SELECT s.session_id, s.title, count(m.id) AS msgs, {seconds('min(m.created_at)')} AS started, {seconds('max(m.created_at)')} AS last
             FROM (SELECT session_id, title FROM sessions UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation) s LEFT JOIN messages m USING (session_id) GROUP BY s.session_id, s.title"""),
)
def session_activity(spark, d):
    rows = derive.sessions(spark, d)
    # Nations stand in for sessions that were opened and never used.
    empty = derive.given(spark, d, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("session_id"), F.col("n_name").alias("title")
    )
    active = sessions.session_activity(
        rows.unionByName(empty, allowMissingColumns=True), derive.messages(spark, d)
    )
    return flat(active.select("session_id", "title", "msgs", "started", "last"))


# ---- memory ----------------------------------------------------------------


@query("M1_memory_decision", ctes("SELECT message_id, reason FROM decided"))
def memory_decision(spark, d):
    pairs = memory.turn_pairs(derive.messages(spark, d))
    return pairs.select("message_id", memory.memory_decision(F.col("question"), F.col("answer")).alias("reason"))


# One text per reason, put in front of every message.
_TEXTS = ["", "I am sorry, ", "Не могу ", "Üzr istəyirəm, ", "No matches: ", "They cannot find it. ", "Out of scope. "]


@query(
    "M1_decision_texts",
    ctes(rf"""SELECT id, CASE WHEN trim(content) = '' THEN 'empty' WHEN length(a) < 80 THEN 'answer_too_short'
                WHEN regexp_matches(substr(a, 1, 500), '{sqlkit.word('|'.join(memory.REFUSALS).replace("'", "''"), open_end=True)}') THEN 'refusal'
                WHEN NOT regexp_matches(a, '\[S\d+\]') THEN 'no_citations' ELSE 'ok' END AS reason
              FROM (SELECT id, content, {sqlkit.trim_blank(f"list_extract({_TEXTS!r}, 1 + id % 7) || content")} AS a FROM messages)"""),
)
def decision_texts(spark, d):
    lead = F.get(F.array(*[F.lit(t) for t in _TEXTS]), (F.col("id") % 7).cast("int"))
    rows = derive.messages(spark, d)
    asked = F.concat(F.lit("A question: "), F.col("content"))
    return rows.select("id", memory.memory_decision(asked, F.concat(lead, F.col("content"))).alias("reason"))


@query(
    "M2_format_pair",
    ctes(f"SELECT message_id, 'Q: ' || {truncate('question', 700)} || chr(10) || 'A: ' || {truncate('answer', 700)} AS content FROM pairs"),
)
def format_pair(spark, d):
    pairs = memory.turn_pairs(derive.messages(spark, d))
    return pairs.select("message_id", memory.format_pair(F.col("question"), F.col("answer")).alias("content"))


@query(
    "M3_build_memory",
    ctes(f"SELECT id, user_id, session_id, message_id, content, question, answer_preview, {seconds('created_at')} AS created_at FROM memory"),
)
def build_memory(spark, d):
    rows = derive.memory(spark, d)
    return flat(
        rows.select("id", "user_id", "session_id", "message_id", "content", "question", "answer_preview", "created_at")
    )


CTES["memory_vectors"] = sqlkit.vectors("memory", "id", "content", "document")
CTES["ask_turns"] = "SELECT id AS query_id, session_id, user_id, content FROM messages JOIN (SELECT session_id, user_id FROM sessions) USING (session_id) WHERE role = 'user'"
CTES["ask_vectors"] = sqlkit.vectors("ask_turns", "query_id", "content", "query")


def _asks(spark, d):
    """Every user turn asks its user's memory from its own session."""
    owners = derive.sessions(spark, d).select("session_id", "user_id")
    return (
        derive.messages(spark, d).filter("role = 'user'").join(owners, "session_id")
        .select(F.col("id").alias("query_id"), "session_id", "user_id", F.col("content").alias("text"))
    )


_RECALL = f"""
  SELECT query_id, id AS memory_id, sim AS similarity, recency, round(sim + 0.08 * recency, 6) AS score, content, created_at,
         row_number() OVER (PARTITION BY query_id ORDER BY round(sim + 0.08 * recency, 6) DESC, id) AS position
  FROM (SELECT *, round(exp(-((epoch_us({AS_OF}) - epoch_us(created_at)) / 86400000000.0::DOUBLE) / 14.0::DOUBLE), 6) AS recency FROM (
    SELECT q.query_id, m.id, m.content, m.created_at, {similarity('qv.vec', 'mv.vec')} AS sim
    FROM ask_turns q JOIN ask_vectors qv USING (query_id) JOIN memory m ON m.user_id = q.user_id AND m.session_id IS DISTINCT FROM q.session_id JOIN memory_vectors mv ON mv.id = m.id
    QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY sim DESC, m.id) <= 9) WHERE sim >= 0.42)
  QUALIFY position <= 3"""


@query("M4_recall", ctes(f"SELECT query_id, memory_id, 'M' || position AS mid, similarity, recency, score FROM ({_RECALL})"))
def recall(spark, d):
    asks = encode.embed(_asks(spark, d), "text", dim=DIM, side="query")
    found = memory.recall(asks, derive.memory(spark, d, DIM), derive.as_of())
    return found.select("query_id", "memory_id", "mid", "similarity", "recency", "score")


@query(
    "S11_memories_block",
    ctes(f"""SELECT query_id, '{context.MEMORY_HEADER.replace("'", "''")}' || chr(10) || string_agg('[M' || position || '] (' || strftime(created_at, '%Y-%m-%d') || ') ' || content, chr(10) ORDER BY position) AS memories_block
             FROM ({_RECALL}) GROUP BY query_id"""),
)
def memories_block(spark, d):
    asks = encode.embed(_asks(spark, d), "text", dim=DIM, side="query")
    return context.memories_block(memory.recall(asks, derive.memory(spark, d, DIM), derive.as_of()))


@query(
    "M5_memory_stats",
    ctes(f"SELECT user_id, count(*) AS total, {seconds('max(created_at)')} AS newest, {seconds('min(created_at)')} AS oldest FROM memory GROUP BY user_id"),
)
def memory_stats(spark, d):
    return flat(memory.memory_stats(derive.memory(spark, d)))


@query("M5_list_memory", ctes("SELECT id, user_id, session_id, substr(content, 1, 100) AS preview FROM memory"))
def list_memory(spark, d):
    return memory.list_memory(derive.memory(spark, d)).drop("created_at")


def _leaving(spark, d):
    """The users numbered like the nations of one region leave."""
    nations = derive.given(spark, d, "nation").filter("n_regionkey = 2")
    return nations.select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("user_id"))


_LEAVING = "(SELECT 'u' || n_nationkey FROM nation WHERE n_regionkey = 2)"


@query(
    "M6_clear_memory",
    ctes(f"""SELECT user_id, 0::BIGINT AS deleted, count(*) AS kept FROM memory WHERE user_id NOT IN {_LEAVING} GROUP BY user_id
             UNION ALL SELECT user_id, count(*), 0 FROM memory WHERE user_id IN {_LEAVING} GROUP BY user_id"""),
)
def clear_memory(spark, d):
    left, deleted = memory.clear(derive.memory(spark, d), _leaving(spark, d))
    kept = left.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept")).withColumn("deleted", F.lit(0).cast("bigint"))
    return kept.unionByName(deleted.withColumn("kept", F.lit(0).cast("bigint")))


@query(
    "M7_forget_users",
    ctes(f"""SELECT 'memory' AS name, user_id, count(*) AS rows FROM memory WHERE user_id NOT IN {_LEAVING} GROUP BY user_id
             UNION ALL SELECT 'profile', user_id, count(*) FROM profiles WHERE user_id NOT IN {_LEAVING} GROUP BY user_id"""),
)
def forget_users(spark, d):
    m, p = memory.forget_users(derive.memory(spark, d), derive.profiles(spark, d), _leaving(spark, d))
    rows = m.select(F.lit("memory").alias("name"), "user_id").unionByName(p.select(F.lit("profile").alias("name"), "user_id"))
    return rows.groupBy("name", "user_id").agg(F.count(F.lit(1)).alias("rows"))
