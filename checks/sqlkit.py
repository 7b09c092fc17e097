"""The derived tables and text rules in DuckDB SQL, as composable CTEs."""

from __future__ import annotations

import re

from checks import derive

BLANK = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def trim_blank(e: str) -> str:
    return rf"regexp_replace({e}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def squeeze(e: str) -> str:
    return rf"trim(regexp_replace({e}, '[{BLANK}]+', ' ', 'g'))"


def normalize(e: str) -> str:
    e = f"coalesce({e}, '')"
    for pattern, replacement in (
        (r"\r\n?", "chr(10)"),
        (r"!\[[^\]]*\]\([^)]*\)", "''"),
        (rf"https?://cdn\.[^{BLANK}]+", "''"),
        (r"\[([^\]]+)\]\([^)]*\)", r"'\1'"),
        (r"[\t ]+", "' '"),
        (r"\n{3,}", "chr(10) || chr(10)"),
    ):
        e = f"regexp_replace({e}, '{pattern}', {replacement}, 'g')"
    return trim_blank(e)


def pieces(array: str) -> str:
    """Trimmed, non-empty elements."""
    return f"list_filter(list_transform({array}, lambda x: {trim_blank('x')}), lambda x: x <> '')"


def paragraphs(e: str) -> str:
    return pieces(rf"regexp_split_to_array({e}, '\n{{2,}}')")


def sentences(e: str) -> str:
    marked = rf"regexp_replace({e}, '([.!?])[{BLANK}]+([A-Z0-9\x22\x27(\[])', '\1' || chr(1) || '\2', 'g')"
    return pieces(f"string_split({marked}, chr(1))")


def tokens(e: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({e}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def cut(e: str, limit: int, keep: int, mark: str) -> str:
    return f"CASE WHEN length({e}) > {limit} THEN substr({e}, 1, {keep}) || '{mark}' ELSE {e} END"


def truncate(e: str, limit: int) -> str:
    return cut(squeeze(f"coalesce({e}, '')"), limit, limit - 1, "…")


def snippet(e: str) -> str:
    return cut(squeeze(f"coalesce({e}, '')"), 240, 240, "...")


def title_of(e: str) -> str:
    clean = squeeze(f"coalesce({e}, '')")
    return f"CASE WHEN {clean} = '' THEN 'New chat' ELSE {cut(clean, 80, 77, '…')} END"


def word(pattern: str, open_end: bool = False) -> str:
    tail = "" if open_end else r"($|[^\p{L}\p{N}_])"
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({pattern}){tail}"


def slot(term: str) -> str:
    return f"(('0x' || substr(md5({term}), 1, 8))::BIGINT % {derive.DIM})"


def micros(ts: str) -> str:
    return f"epoch_us({ts})"


def seconds(ts: str) -> str:
    return f"(epoch_us({ts}) // 1000000)"


def pick(values: dict[int, object]) -> str:
    arms = " ".join(
        f"WHEN {at} THEN " + (str(v) if isinstance(v, int) else f"'{v}'") for at, v in values.items()
    )
    return f"CASE event_id % 16 {arms} END"


def vectors(source: str, key: str, text: str, side: str) -> str:
    """CTE body: key and unit vector (as stored, single precision) of a text."""
    weight = "1.0" if side == "query" else "1.0 + ln(count(*))"
    return f"""
      SELECT {key}, list((CASE WHEN norm > 0 THEN w / norm ELSE 0.0 END)::FLOAT::DOUBLE ORDER BY dim) AS vec
      FROM (
        SELECT k.{key}, r.dim, coalesce(s.w, 0.0) AS w, sqrt(sum(coalesce(s.w, 0.0) ** 2) OVER (PARTITION BY k.{key})) AS norm
        FROM (SELECT {key} FROM {source}) k CROSS JOIN range({derive.DIM}) r(dim)
        LEFT JOIN (
          SELECT {key}, {slot('term')} AS dim, sum(w) AS w
          FROM (SELECT {key}, term, {weight} AS w FROM (SELECT {key}, unnest({tokens(text)}) AS term FROM {source}) GROUP BY {key}, term)
          GROUP BY 1, 2
        ) s ON s.{key} = k.{key} AND s.dim = r.dim
      ) GROUP BY {key}"""


def similarity(a: str, b: str) -> str:
    sim = f"list_cosine_similarity({a}, {b})"
    return f"(round(CASE WHEN isnan({sim}) THEN 0.0 ELSE {sim} END, 6) + 0.0)"


AS_OF = f"TIMESTAMP '{derive.AS_OF}'"

CTES: dict[str, str] = {
    "corpus": r"""
      SELECT doc_id AS doc_no, substr(sha1(url), 1, 16) AS doc_id, url,
             'Document ' || doc_id || ', ' || source AS title, replace(text, chr(10), chr(10) || chr(10)) AS markdown,
             CASE doc_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'static' ELSE 'upload' END AS doc_type,
             lang AS language, text AS description,
             CASE WHEN doc_id % 3 = 2 THEN (doc_id % 100)::VARCHAR END AS session_id,
             1 + n_chars // 1000 AS total_pages, n_chars // 1024 AS size_kb,
             TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at
      FROM (SELECT *, 'http://' || source || '.example.com/' || lang || '/articles/' || doc_id AS url FROM documents)""",
    "listings": r"""
      SELECT p_partkey AS doc_no, substr(sha1(url), 1, 16) AS doc_id, url,
             p_name || ', ' || coalesce(n_name, '') AS title,
             'Price: ' || CASE p_size % 4 WHEN 0 THEN '$' || grouped WHEN 1 THEN '€ ' || price WHEN 2 THEN 'AZN ' || grouped ELSE grouped || ' ₼' END
             || chr(10) || CASE p_partkey % 3
               WHEN 0 THEN (rooms - 1) || '-bedroom ' || kind || ' ' || deal || ', ' || (1 + p_size % 3) || ' bathrooms, ' || area || ' sqm'
               WHEN 1 THEN rooms || ' otaqlı ' || kind || ' ' || deal || ', ' || (1 + p_size % 3) || ' hamam, ' || area || ' kvm'
               ELSE rooms || '-комнатная ' || kind || ' ' || deal || ', ' || area || ' м²' END
             || chr(10) || p_brand AS markdown,
             'listing' AS doc_type,
             CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'az' ELSE 'ru' END AS language
      FROM (
        SELECT *, (price // 1000) || ',' || lpad((price % 1000)::VARCHAR, 3, '0') AS grouped,
          'https://homes.example.com' || CASE p_partkey % 3 WHEN 0 THEN '/en/units/' WHEN 1 THEN '/az/menziller/' ELSE '/ru/kvartiry/' END
            || replace(p_name, ' ', '-') || '-' || p_partkey AS url
        FROM (
          SELECT p.*, n.n_name, round(p_retailprice * 1000)::BIGINT AS price, 2 + p_size % 5 AS rooms, 40 + p_size * 3 AS area,
            CASE p_size % 4 WHEN 0 THEN 'apartment' WHEN 1 THEN 'villa' WHEN 2 THEN 'office' ELSE 'shop' END AS kind,
            CASE WHEN p_size % 2 = 1 THEN 'for sale' ELSE 'for rent' END AS deal
          FROM part p LEFT JOIN nation n ON n.n_nationkey = p.p_partkey % 25
        )
      )""",
    "bodies": f"SELECT *, {normalize('markdown')} AS body FROM corpus",
    "chunks": f"""
      SELECT doc_no * 10000 + ord AS chunk_id, doc_no, doc_id, url, ord AS chunk_index, content, session_id, doc_type, language
      FROM (
        SELECT * EXCLUDE (parts), unnest(parts) AS content, unnest(range(len(parts))) AS ord
        FROM (SELECT *, {paragraphs('body')} AS parts FROM bodies)
      )""",
    "questions": f"""
      SELECT item_id * 1000 + ord AS query_id, text,
             CASE WHEN item_id % 4 <> 3 THEN 'u' || (item_id % 20) END AS user_id,
             (item_id % 100)::VARCHAR AS session_id,
             CASE ord % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'vector' ELSE 'lexical' END AS mode,
             CASE WHEN ord % 2 = 0 THEN item_id % 70 END AS top_k,
             CASE WHEN item_id % 2 = 0 THEN item_id % 90 END AS candidate_k, item_id
      FROM (
        SELECT item_id, unnest(parts) AS text, unnest(range(len(parts))) AS ord
        FROM (SELECT item_id, {pieces("regexp_split_to_array(text, '[.!?][[:space:]]+')")} AS parts FROM benchmark)
      )""",
    "wanted": """
      SELECT *, CASE query_id % 3 WHEN 0 THEN ['en'] WHEN 1 THEN ['en', 'fr'] END AS languages,
             CASE WHEN query_id % 2 = 0 THEN ['article', 'upload'] END AS types
      FROM questions""",
    "turns": """
      SELECT *, TIMESTAMP '2024-03-01' + to_hours(conv_id) + to_minutes(turn) AS created_at
      FROM conversations WHERE role IN ('user', 'assistant')""",
    "messages": """
      SELECT conv_id * 1000 + turn AS id, conv_id::VARCHAR AS session_id, role,
             CASE WHEN role = 'assistant' THEN text || CASE WHEN turn % 4 <> 3 THEN ' [S1][S' || (1 + (conv_id + turn) % 9) || ']' ELSE '' END
                  ELSE text END AS content,
             CASE WHEN role = 'assistant' THEN list_transform(range(1, 2 + (conv_id * 7 + turn) % 5),
                  lambda i: (conv_id * 31 + turn * 7 + i * 13) % 97) END AS sources,
             CASE WHEN role = 'assistant' THEN
               '{"model":"m' || (conv_id % 3) || '","usage":{"input_tokens":' || length(text) || ',"output_tokens":' || (length(text) // 4)
               || ',"cache_read_input_tokens":' || (turn * 100) || '},"stop_reason":"' || CASE WHEN conv_id % 6 = 5 THEN 'max_tokens' ELSE 'end_turn' END
               || '","retrieval":{"mode":"' || CASE WHEN turn % 3 = 0 THEN 'vector' ELSE 'hybrid' END || '","reranked":'
               || CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"fallback":null,"cached":false,"topK":8}}'
             ELSE '{}' END AS metadata, created_at
      FROM turns""",
    "sessions": f"""
      SELECT conv_id::VARCHAR AS session_id, 'u' || (conv_id % 20) AS user_id,
             CASE WHEN conv_id % 5 <> 0 THEN {title_of('first')} END AS title,
             TIMESTAMP '2024-03-01' + to_hours(conv_id) AS created_at, updated_at
      FROM (SELECT conv_id, max(created_at) AS updated_at, min_by(text, turn) FILTER (role = 'user') AS first FROM turns GROUP BY conv_id)""",
    "pairs": """
      SELECT m.*, s.user_id FROM (
        SELECT session_id, role, content AS question, lead(role) OVER w AS next_role, lead(id) OVER w AS message_id,
               lead(content) OVER w AS answer, lead(metadata) OVER w AS metadata, lead(created_at) OVER w AS created_at
        FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)
      ) m JOIN sessions s USING (session_id) WHERE role = 'user' AND next_role = 'assistant'""",
    "saves": """
      SELECT event_id AS id, 'u' || (user_id % 20) AS user_id, event_id % 1100 AS doc_no, 'd' || (event_id % 1100) AS doc_id,
             CASE WHEN value > 20 THEN 'note ' || json_extract_string(props, '$.k') END AS note, ts AS created_at
      FROM events WHERE event_type = 'purchase'""",
    "docs": "SELECT * REPLACE ('d' || doc_no AS doc_id) FROM corpus",
    "favorites": """
      SELECT id, user_id, doc_id, note, created_at FROM saves WHERE doc_id IN (SELECT doc_id FROM docs)
      QUALIFY row_number() OVER (PARTITION BY user_id, doc_id ORDER BY id) = 1""",
    "profiles": """
      SELECT 'u' || n AS user_id, 'Looks for ' || size || ' things' AS summary, n % 7 AS basis_memory_n, n * 3 AS basis_favorite_n,
             n % 4 AS basis_upload_n, TIMESTAMP '2024-03-20' - to_seconds(n * 10) AS refreshed_at, TIMESTAMP '2024-03-20' - to_seconds(n * 10) AS updated_at
      FROM (SELECT c_custkey % 25 AS n, count(*) AS size FROM customer GROUP BY 1)""",
    "parts": r"""
      SELECT CASE WHEN grp % 11 = 0 THEN digest ELSE substr(digest,1,8) || '-' || substr(digest,9,4) || '-' || substr(digest,13,4) || '-' || substr(digest,17,4) || '-' || substr(digest,21,12) END AS upload_id,
             part AS part_index, 1 + grp % 3 AS total_parts, 'file' || grp || CASE WHEN grp % 7 = 0 THEN '.txt' ELSE '.PDF' END AS filename,
             'u' || (grp % 20) AS user_id,
             CASE WHEN event_id % 50 = 0 THEN '' ELSE CASE WHEN part = 0 AND grp % 6 <> 0 THEN '%PDF-' ELSE '' END || 'part ' || part || ' ' || props END AS data,
             ts AS created_at
      FROM (SELECT *, event_id // 40 AS grp, md5('up' || (event_id // 40)) AS digest, (event_id % 40) // 12 AS part FROM events WHERE event_type = 'signup')""",
    "error_log": f"""
      SELECT event_id AS id, {pick(derive.ERROR_NAMES)} AS name, {pick(derive.ERROR_STATUSES)} AS status, {pick(derive.ERROR_KINDS)} AS type,
             {pick(derive.ERROR_MESSAGES)} || ' ' || props AS message, {pick(derive.ERROR_CODES)} AS code
      FROM events WHERE event_type = 'error'""",
    "scores": """
      SELECT l.doc_id::VARCHAR AS id, 'c' || (l.doc_id % 8) AS category, lang AS language,
             CASE WHEN quality = 1 THEN 3 + l.doc_id % 3 WHEN l.doc_id % 5 <> 0 THEN l.doc_id % 4 END AS faithfulness,
             'reason ' || l.doc_id AS faithful_reason,
             CASE WHEN l.doc_id % 9 <> 0 THEN 2 + l.doc_id % 4 END AS relevance, toxic = 0 AS language_match,
             CASE WHEN toxic = 1 THEN l.doc_id % 2 = 0 END AS refusal_correct,
             CASE WHEN l.doc_id % 3 <> 0 THEN l.doc_id % 7 <> 0 END AS retrieval_recall, l.doc_id % 10 <> 0 AS citations_valid, n_chars / 100.0::DOUBLE AS latency
      FROM labels l JOIN documents d USING (doc_id)""",
    "flags": "SELECT *, faithfulness >= 4 AS faithful, relevance >= 4 AS relevant FROM scores",
    "eval_questions": f"""
      SELECT item_id::VARCHAR AS id, item_id AS query_id, text, 'c' || (item_id % 8) AS category,
             list_sort(list_distinct(list_filter({tokens('text')}, lambda t: length(t) >= 12))) AS must_match, item_id % 5 = 0 AS no_match_expected
      FROM benchmark""",
    "chunk_vectors": vectors("chunks", "chunk_id", "content", "document"),
    "query_vectors": vectors("questions", "query_id", "text", "query"),
    "eval_vectors": vectors("eval_questions", "query_id", "text", "query"),
    "chunk_words": f"SELECT chunk_id, {tokens('content')} AS toks FROM chunks",
    "query_words": f"SELECT query_id, list_distinct({tokens('text')}) AS terms FROM questions",
    "postings": """
      SELECT chunk_id, term, pos FROM (
        SELECT chunk_id, unnest(toks) AS term, unnest(range(1, len(toks) + 1)) AS pos FROM chunk_words)""",
    "owned": """
      SELECT c.*, s.user_id AS owner FROM chunks c LEFT JOIN sessions s ON s.session_id = c.session_id""",
    # every query term in the chunk
    "matched": """
      SELECT q.query_id, p.chunk_id, count(DISTINCT p.term) AS hit
      FROM (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM query_words) q JOIN postings p USING (term)
      GROUP BY q.query_id, p.chunk_id, q.n HAVING count(DISTINCT p.term) = q.n""",
    # cover density over the hits of a matched pair
    "hits": """
      SELECT m.query_id, m.chunk_id, p.term, p.pos, row_number() OVER (PARTITION BY m.query_id, m.chunk_id ORDER BY p.pos) AS nth
      FROM matched m JOIN (SELECT query_id, unnest(terms) AS term FROM query_words) q USING (query_id)
      JOIN postings p ON p.chunk_id = m.chunk_id AND p.term = q.term""",
    "covers": """
      SELECT e.query_id, e.chunk_id, e.pos AS q, e.nth AS qn, min(l.last_pos) AS p, min(l.last_nth) AS pn
      FROM hits e JOIN LATERAL (
        SELECT h.term, max(h.pos) AS last_pos, max(h.nth) AS last_nth FROM hits h
        WHERE h.query_id = e.query_id AND h.chunk_id = e.chunk_id AND h.pos <= e.pos GROUP BY h.term
      ) l ON TRUE JOIN (SELECT query_id, len(terms) AS n FROM query_words) w ON w.query_id = e.query_id
      GROUP BY e.query_id, e.chunk_id, e.pos, e.nth, w.n HAVING count(*) = w.n""",
    "lexical": """
      SELECT query_id, chunk_id, round(sum(0.1::DOUBLE / (1 + (q - p) - (qn - pn))), 6) AS lexical
      FROM (SELECT query_id, chunk_id, p, pn, min(q) AS q, min(qn) AS qn FROM covers GROUP BY query_id, chunk_id, p, pn)
      GROUP BY query_id, chunk_id""",
    "sims": f"""
      SELECT q.query_id, c.chunk_id, {similarity('q.vec', 'c.vec')} AS sim FROM query_vectors q CROSS JOIN chunk_vectors c""",
    "near": """
      SELECT query_id, chunk_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rnk
      FROM sims QUALIFY rnk <= 32""",
    "worded": """
      SELECT query_id, chunk_id, lexical, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) AS rnk
      FROM lexical QUALIFY rnk <= 32""",
    "fused": """
      SELECT query_id, chunk_id, coalesce(max(sim), 0.0::DOUBLE) AS vector_score, coalesce(max(lexical), 0.0::DOUBLE) AS lexical_score,
             round(sum(1.0::DOUBLE / (60 + rnk)), 10) AS rrf_score
      FROM (SELECT query_id, chunk_id, sim, NULL AS lexical, rnk FROM near UNION ALL
            SELECT query_id, chunk_id, NULL, lexical, rnk FROM worded) GROUP BY query_id, chunk_id""",
    "hybrid": """
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rnk FROM fused QUALIFY rnk <= 32""",
}
CTES["memory"] = f"""
      SELECT message_id AS id, user_id, session_id, message_id, 'Q: ' || {truncate('question', 700)} || chr(10) || 'A: ' || {truncate('answer', 700)} AS content,
             {truncate('question', 200)} AS question, {truncate('answer', 200)} AS answer_preview, created_at
      FROM decided WHERE reason = 'ok' AND json_extract_string(metadata, '$.stop_reason') = 'end_turn'"""


def ctes(body: str) -> str:
    """``WITH`` clause for every named CTE the body uses, in dependency order."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in CTES:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql) and name not in order:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    inner = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in order)
    if not order:
        return body
    start = body.lstrip()
    for word_ in ("WITH RECURSIVE ", "WITH "):
        if start.upper().startswith(word_):
            return f"{word_}{inner},\n{start[len(word_):]}"
    return f"WITH {inner}\n{body}"
