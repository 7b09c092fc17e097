"""Filters, vector, lexical and hybrid search, shaping and prompt text (R, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derive, sqlkit
from checks.registry import SQL, flat, query
from checks.sqlkit import CTES, ctes, similarity
from corpusflow.operators import context, filters, fusion, index, lexical, vector
from corpusflow.session import written
from corpusflow.sources import appended, tables
from corpusflow.streaming.run import fresh_dir

# ---- filters ---------------------------------------------------------------


@query(
    "R1_equality_filters",
    ctes("SELECT chunk_id, doc_type, language FROM chunks WHERE language IN ('en', 'fr') AND doc_type = 'article'"),
)
def equality_filters(spark, d):
    chunks = derive.paragraph_chunks(spark, d)
    kept = filters.apply_filters(chunks, {"language": ["en", "fr"], "doc_type": "article"})
    return kept.select("chunk_id", "metadata.doc_type", "metadata.language")


@query(
    "R2_range_filters",
    """SELECT p_partkey AS doc_no, round(p_retailprice * 1000) AS price, (40 + p_size * 3)::DOUBLE AS area_sqm FROM part
       WHERE round(p_retailprice * 1000) BETWEEN 900500 AND 1400000 AND p_partkey % 3 = 0 AND 1 + p_size % 5 BETWEEN 2 AND 4 AND 40 + p_size * 3 >= 60""",
)
def range_filters(spark, d):
    from corpusflow.operators import corpus

    listings = corpus.with_facts(derive.listings(spark, d))
    kept = filters.apply_filters(
        listings, {"price_min": 900500, "price_max": 1400000, "bedrooms_min": 2, "bedrooms_max": 4, "area_min": 60}
    )
    return kept.select("doc_no", "metadata.price", "metadata.area_sqm")


@query(
    "R3_json_containment",
    ctes("""SELECT id FROM messages WHERE json_extract_string(metadata, '$.retrieval.mode') = 'hybrid'
            AND json_extract_string(metadata, '$.stop_reason') = 'end_turn' AND (metadata->'$.usage.cache_read_input_tokens')::BIGINT = 100"""),
)
def json_containment(spark, d):
    wanted = {"stop_reason": "end_turn", "retrieval": {"mode": "hybrid"}, "usage": {"cache_read_input_tokens": 100}}
    return filters.contains(derive.messages(spark, d), wanted, "metadata").select("id")


_PASSES = """(w.languages IS NULL OR list_contains(w.languages, c.language)) AND (w.types IS NULL OR list_contains(w.types, c.doc_type))
             AND (c.session_id IS NULL OR coalesce(c.owner = w.user_id, false))"""


@query(
    "R4_filtered_pairs",
    ctes(f"""SELECT m.query_id, m.chunk_id FROM matched m JOIN wanted w USING (query_id) JOIN owned c USING (chunk_id) WHERE {_PASSES}"""),
)
def filtered_pairs(spark, d):
    queries = derive.with_filters(derive.questions(spark, d))
    chunks = filters.with_owner(lexical.with_tokens(derive.paragraph_chunks(spark, d)), derive.sessions(spark, d))
    pairs = lexical.match_all(queries, chunks).select("query_id", "chunk_id")
    return filters.filtered_pairs(pairs, queries, chunks)


@query(
    "R5_ownership_scope",
    ctes("SELECT chunk_id, session_id FROM chunks WHERE session_id IS NULL OR session_id IN (SELECT session_id FROM sessions WHERE user_id = 'u8')"),
)
def ownership_scope(spark, d):
    return filters.ownership_scope(derive.paragraph_chunks(spark, d), derive.sessions(spark, d), "u8").select(
        "chunk_id", "session_id"
    )


# ---- vectors ---------------------------------------------------------------


def _vector_tables(spark, d):
    """Every vector is an item; every vector also asks."""
    e = derive.given(spark, d, "embeddings")
    queries = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return queries, e.select(F.col("vec_id").alias("item_id"), "embedding")


_NEAREST = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
        SELECT q.vec_id AS query_id, i.vec_id AS item_id, {similarity('q.e', 'i.e')} AS similarity,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {similarity('q.e', 'i.e')} DESC, i.vec_id) AS rank
        FROM v q CROSS JOIN v i QUALIFY rank <= 10"""


@query("R6_knn_exact", _NEAREST)
def knn_exact(spark, d):
    return flat(vector.knn(*_vector_tables(spark, d), 10))


@query(
    "R6_knn_scoped",
    ctes(f"""SELECT w.query_id, c.chunk_id AS item_id, s.sim AS similarity, row_number() OVER (PARTITION BY w.query_id ORDER BY s.sim DESC, c.chunk_id) AS rank
             FROM sims s JOIN wanted w USING (query_id) JOIN owned c USING (chunk_id) WHERE {_PASSES} QUALIFY rank <= 8"""),
)
def knn_scoped(spark, d):
    queries = derive.with_filters(derive.asked(spark, d))
    chunks = filters.with_owner(derive.search_chunks(spark, d), derive.sessions(spark, d))
    items = chunks.withColumnRenamed("chunk_id", "item_id")
    return flat(vector.knn(queries, items, 8, filters=True, scope=True))


@query("R7_knn_all_cells", _NEAREST)
def knn_all_cells(spark, d):
    """Looking into every cell gives the exact result."""
    queries, items = _vector_tables(spark, d)
    return flat(vector.knn_approx(queries, items, 10, cells=vector.train_cells(items, 10), probes=10))


# Centres are the mean vector of each label, so the cells have an SQL twin.
_CELLS = f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        m AS (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS dim FROM v) GROUP BY ALL),
        c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cell, list(x ORDER BY dim) AS e FROM m GROUP BY label),
        d AS (SELECT vec_id, e, list(cell ORDER BY sim DESC, cell) AS cells
              FROM (SELECT vec_id, v.e, cell, round(list_dot_product(v.e, c.e) / sqrt(list_dot_product(c.e, c.e)), 9) AS sim FROM v CROSS JOIN c) GROUP BY ALL)"""


def _in_cells(probes: str, extra: str = "") -> str:
    """The ten nearest among the items of each query's first cells."""
    return f"""SELECT {extra} q.vec_id AS query_id, i.vec_id AS item_id, {similarity('q.e', 'i.e')} AS similarity,
               row_number() OVER (PARTITION BY {extra} q.vec_id ORDER BY {similarity('q.e', 'i.e')} DESC, i.vec_id) AS rank
        FROM d q JOIN d i ON list_contains(q.cells[1:{probes}], i.cells[1])"""


def _labelled(spark, d):
    e = derive.given(spark, d, "embeddings")
    return index.mean_centres(e, "label")


@query("R7_knn_cells", f"{_CELLS} {_in_cells('8')} QUALIFY rank <= 10")
def knn_cells(spark, d):
    queries, items = _vector_tables(spark, d)
    return flat(vector.knn_approx(queries, items, 10, cells=_labelled(spark, d), probes=8))


@query("R7_knn_stored_cells", f"{_CELLS} {_in_cells('8')} QUALIFY rank <= 10")
def knn_stored_cells(spark, d):
    """Served from the stored cells, after a load that adds a third of the vectors and moves others."""
    queries, items = _vector_tables(spark, d)
    path = fresh_dir(spark, "cells")
    chunks = items.withColumnRenamed("item_id", "chunk_id")
    third, fifth = F.col("chunk_id") % 3 == 0, F.col("chunk_id") % 5 == 0
    moved = F.when(fifth, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    before = chunks.filter(~third).withColumn("embedding", moved.cast("array<float>"))
    index.build_cells(before, path, _labelled(spark, d))
    index.update_cells(before.filter(fifth), chunks.filter(third | fifth), path)
    return flat(index.knn_stored(spark, path, queries, 10, probes=8))


_PROBES = [1, 2, 4, 8, 10]


@query(
    "R8_recall_by_probes",
    f"""{_CELLS}, p AS (SELECT unnest({_PROBES}) AS probes), a AS (
          {_in_cells('probes', 'probes,').replace("FROM d q", "FROM p CROSS JOIN d q")} QUALIFY rank <= 10
        ), x AS (SELECT query_id, item_id FROM a WHERE probes = {_PROBES[-1]})
        SELECT probes::BIGINT AS probes, round(avg(CASE WHEN a.item_id IS NULL THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS recall, count(*) AS pairs
        FROM p CROSS JOIN x LEFT JOIN a USING (probes, query_id, item_id) GROUP BY probes""",
)
def recall_by_probes(spark, d):
    """Looking into all ten cells is exact."""
    queries, items = _vector_tables(spark, d)
    return flat(vector.recall_by_probes(queries, items, 10, _labelled(spark, d), _PROBES))


# ---- words -----------------------------------------------------------------


@query(
    "L1_postings",
    ctes("SELECT chunk_id, term, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM postings GROUP BY chunk_id, term"),
)
def postings(spark, d):
    built = lexical.build_postings(derive.paragraph_chunks(spark, d))
    joined = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")
    return flat(built.select("chunk_id", "term", "tf", joined.alias("positions")))


@query("L2_match_all", ctes("SELECT query_id, chunk_id, hit AS terms FROM matched"))
def match_all(spark, d):
    chunks = lexical.with_tokens(derive.paragraph_chunks(spark, d))
    found = lexical.match_all(derive.questions(spark, d), chunks)
    return flat(found.select("query_id", "chunk_id", F.size("terms").alias("terms")))


@query("L3_cover_density", ctes("SELECT query_id, chunk_id, lexical FROM lexical"))
def cover_density(spark, d):
    chunks = lexical.with_tokens(derive.paragraph_chunks(spark, d))
    return lexical.rank_cover(lexical.match_all(derive.questions(spark, d), chunks))


@query("L4_lexical_search", ctes("SELECT query_id, chunk_id, lexical, rnk AS rank FROM worded"))
def lexical_search(spark, d):
    chunks = lexical.with_tokens(derive.paragraph_chunks(spark, d))
    return flat(lexical.lexical_search(derive.questions(spark, d), chunks, 32))


def _stored_postings(spark, d):
    """The lists of all paragraphs, written as the earlier state and one load that changes, adds and removes chunks."""
    path = fresh_dir(spark, "postings")
    now = written(lexical.with_tokens(derive.paragraph_chunks(spark, d)).select("chunk_id", "content", "tokens"))
    added, changed = F.col("chunk_id") % 7 == 0, F.col("chunk_id") % 7 == 1
    drafts = written(lexical.with_tokens(now.filter(changed).withColumn("content", F.concat(F.lit("draft of "), F.reverse("content")))))
    lost = now.filter("chunk_id % 7 = 2").withColumn("chunk_id", -F.col("chunk_id") - 1)
    index.build_postings_store(now.filter(~added & ~changed).unionByName(drafts).unionByName(lost), path, parts=16)
    index.update_postings(drafts.unionByName(lost), now.filter(added | changed), path, parts=16)
    return path


@query("L4_stored_postings", ctes("SELECT query_id, chunk_id, lexical, rnk AS rank FROM worded"))
def stored_postings(spark, d):
    return flat(index.lexical_stored(spark, _stored_postings(spark, d), derive.questions(spark, d), 32, parts=16))


@query(
    "L1_stored_terms",
    ctes("SELECT term, count(DISTINCT chunk_id) AS df FROM postings GROUP BY term"),
)
def stored_terms(spark, d):
    return flat(appended.read(spark, f"{_stored_postings(spark, d)}/terms", ["term"]))


@query(
    "L4_short_queries",
    ctes("""WITH words AS MATERIALIZED (SELECT item_id * 1000 + ord AS query_id, t AS term FROM (
                SELECT item_id, unnest(ts) AS t, unnest(range(len(ts))) AS ord FROM (
                  SELECT item_id, list_sort(list_distinct(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+'))) AS ts FROM benchmark)) WHERE t <> ''),
              tf AS (SELECT w.query_id, p.chunk_id, round(sum(0.1::DOUBLE), 6) AS lexical FROM words w JOIN postings p USING (term) GROUP BY 1, 2)
            SELECT query_id, chunk_id, lexical, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) AS rank
            FROM tf QUALIFY rank <= 5"""),
)
def short_queries(spark, d):
    """One query per distinct word of every benchmark item, frequent words included."""
    words = F.array_sort(F.array_distinct(F.split(F.lower("text"), "[^a-zà-ÿ]+")))
    asked = (
        derive.given(spark, d, "benchmark")
        .select("item_id", F.posexplode(words).alias("ord", "text"))
        .filter("text != ''")
        .select((F.col("item_id") * 1000 + F.col("ord")).alias("query_id"), "text")
    )
    chunks = lexical.with_tokens(derive.paragraph_chunks(spark, d))
    return flat(lexical.lexical_search(asked, chunks, 5))


# ---- fusion ----------------------------------------------------------------


@query("R9_rrf", ctes("SELECT query_id, chunk_id, rrf_score FROM fused"))
def rrf(spark, d):
    queries, chunks = derive.asked(spark, d), derive.search_chunks(spark, d)
    near = fusion.vector_hits(queries, chunks, 32).withColumnRenamed("item_id", "chunk_id")
    worded = lexical.lexical_search(queries, chunks, 32)
    return fusion.rrf([near, worded])


# One cell per language: the mean vector of its chunks. Questions look into two.
CTES["chunk_centres"] = """
      SELECT row_number() OVER (ORDER BY language) - 1 AS cell, list(x ORDER BY dim) AS e
      FROM (SELECT language, dim, avg(x) AS x FROM (SELECT language, unnest(vec) AS x, unnest(range(len(vec))) AS dim
            FROM chunk_vectors JOIN chunks USING (chunk_id)) GROUP BY ALL) GROUP BY language"""
_TO_CENTRE = "round(list_dot_product(v.vec, c.e) / sqrt(list_dot_product(c.e, c.e)), 9)"
CTES["chunk_cells"] = f"""
      SELECT chunk_id, min_by(cell, {{'minus': -sim, 'cell': cell}}) AS cell
      FROM (SELECT chunk_id, cell, {_TO_CENTRE} AS sim FROM chunk_vectors v CROSS JOIN chunk_centres c) GROUP BY chunk_id"""
CTES["query_cells"] = f"""
      SELECT query_id, cell FROM (SELECT query_id, cell, {_TO_CENTRE} AS sim FROM query_vectors v CROSS JOIN chunk_centres c)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cell) <= 2"""
CTES["near_cells"] = """
      SELECT query_id, chunk_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rnk
      FROM sims JOIN chunk_cells USING (chunk_id) JOIN query_cells USING (query_id, cell) QUALIFY rnk <= 32"""
CTES["fused_cells"] = CTES["fused"].replace("FROM near ", "FROM near_cells ")


@query(
    "R10_hybrid_stored",
    ctes("""SELECT query_id, chunk_id, vector_score, lexical_score, rrf_score,
              row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM fused_cells QUALIFY rank <= 32"""),
)
def hybrid_stored(spark, d):
    """Both lists from the stored index; of four cells each question opens two."""
    path = fresh_dir(spark, "index")
    chunks = written(derive.search_chunks(spark, d))
    index.build_cells(chunks, path, index.mean_centres(chunks.withColumn("language", F.col("metadata.language")), "language"))
    index.build_postings_store(chunks, path, parts=16)
    return flat(index.hybrid_stored(spark, path, derive.asked(spark, d), probes=2, parts=16))


@query(
    "R10_hybrid_search",
    ctes("SELECT h.query_id, h.chunk_id, c.doc_id, c.content, vector_score, lexical_score, rrf_score, rnk AS rank FROM hybrid h JOIN chunks c USING (chunk_id)"),
)
def hybrid_search(spark, d):
    hits = fusion.hybrid_search(
        derive.asked(spark, d), written(derive.search_chunks(spark, d)), columns=["doc_id", "content"]
    )
    return flat(
        hits.select("query_id", "chunk_id", "doc_id", "content", "vector_score", "lexical_score", "rrf_score", "rank")
    )


_MIXED = """
  SELECT f.query_id, f.chunk_id, f.vector_score, f.lexical_score, q.mode, CASE WHEN q.mode = 'hybrid' THEN rrf_score ELSE 0.0::DOUBLE END AS rrf_score,
         row_number() OVER (PARTITION BY f.query_id ORDER BY CASE q.mode WHEN 'vector' THEN vector_score WHEN 'lexical' THEN lexical_score ELSE rrf_score END DESC, f.chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, coalesce(max(sim), 0.0::DOUBLE) AS vector_score, coalesce(max(lexical), 0.0::DOUBLE) AS lexical_score,
               round(sum(1.0::DOUBLE / (60 + rnk)), 10) AS rrf_score
        FROM (SELECT query_id, chunk_id, sim, NULL AS lexical, rnk FROM near JOIN questions USING (query_id) WHERE mode <> 'lexical'
              UNION ALL SELECT query_id, chunk_id, NULL, lexical, rnk FROM worded JOIN questions USING (query_id) WHERE mode <> 'vector')
        GROUP BY query_id, chunk_id) f JOIN questions q USING (query_id) QUALIFY rank <= 32"""


@query("R11_search_modes", ctes(f"SELECT query_id, chunk_id, mode, vector_score, lexical_score, rrf_score, rank FROM ({_MIXED})"))
def search_modes(spark, d):
    hits = fusion.search(derive.asked(spark, d), derive.search_chunks(spark, d))
    return flat(hits.select("query_id", "chunk_id", "mode", "vector_score", "lexical_score", "rrf_score", "rank"))


@query(
    "R11_search_status",
    ctes(f"""SELECT q.query_id, CASE WHEN q.mode = 'hybrid' AND n IS NULL THEN 'vector' ELSE q.mode END AS mode,
               CASE WHEN q.mode = 'hybrid' AND n IS NULL THEN 'lexical-empty' END AS fallback, coalesce(n, 0) AS hits, coalesce(w, 0) AS lexical_hits
             FROM questions q LEFT JOIN (SELECT query_id, count(*) AS n, count(*) FILTER (lexical_score > 0) AS w FROM ({_MIXED}) GROUP BY 1) h USING (query_id)"""),
)
def search_status(spark, d):
    queries = derive.asked(spark, d)
    return flat(fusion.search_status(queries, fusion.search(queries, derive.search_chunks(spark, d))))


@query(
    "R12_search_params",
    ctes("""SELECT query_id, least(50, greatest(1, coalesce(top_k, 8)))::BIGINT AS top_k,
              greatest(least(50, greatest(1, coalesce(top_k, 8))), coalesce(candidate_k, 32))::BIGINT AS candidate_k FROM questions"""),
)
def search_params(spark, d):
    return flat(fusion.search_params(derive.questions(spark, d)).select("query_id", "top_k", "candidate_k"))


_RERANKED = f"""
  SELECT h.query_id, h.chunk_id, h.rnk, c.doc_id, c.url, c.chunk_index, c.content, c.doc_type, c.language, h.vector_score, h.lexical_score, h.rrf_score,
    CASE WHEN count(*) OVER (PARTITION BY h.query_id) > 1 THEN
      CASE WHEN len(w.terms) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(w.terms, k.toks)) / len(w.terms)::DOUBLE, 6) END END AS rerank_score
  FROM hybrid h JOIN chunks c USING (chunk_id) JOIN query_words w USING (query_id) JOIN chunk_words k USING (chunk_id)"""
_POSITIONED = f"""
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rnk) AS position FROM ({_RERANKED}) QUALIFY position <= 8"""


def _reranked(spark, d):
    queries = derive.asked(spark, d)
    hits = fusion.hybrid_search(
        queries, written(derive.search_chunks(spark, d)), columns=["doc_id", "url", "chunk_index", "content", "metadata"]
    )
    return fusion.rerank(hits.join(queries.select("query_id", "text"), "query_id"), 8)


@query("R13_rerank", ctes(f"SELECT query_id, chunk_id, rerank_score, position FROM ({_POSITIONED})"))
def rerank(spark, d):
    return flat(_reranked(spark, d).select("query_id", "chunk_id", "rerank_score", "position"))


@query(
    "R14_shape_sources",
    ctes(f"""SELECT query_id, 'S' || position AS sid, chunk_id AS id, doc_id, chunk_index,
               coalesce(nullif(rerank_score, 0), nullif(rrf_score, 0), nullif(vector_score, 0), 0.0::DOUBLE) AS score,
               nullif(rerank_score, 0) AS rerank_score, vector_score, lexical_score, rrf_score, {sqlkit.snippet('content')} AS snippet FROM ({_POSITIONED})"""),
)
def shape_sources(spark, d):
    shaped = fusion.shape_sources(_reranked(spark, d))
    return flat(
        shaped.select("query_id", "sid", "id", "doc_id", "chunk_index", "score", "rerank_score", "vector_score",
                      "lexical_score", "rrf_score", "snippet")
    )


_VISIBLE = "(c.session_id IS NULL OR coalesce(c.owner = q.user_id, false))"
_ASKED = """
  SELECT *, least(50, greatest(1, coalesce(top_k, 8))) AS tk, greatest(least(50, greatest(1, coalesce(top_k, 8))), coalesce(candidate_k, 32)) AS ck FROM questions"""


def _retrieved(choices: bool) -> str:
    """Source rows with each question's limits and scope; with ``choices`` its mode and its rerank switch count too."""
    sides = ("q.mode <> 'lexical' AND ", "q.mode <> 'vector' AND ") if choices else ("", "")
    order = "CASE q.mode WHEN 'vector' THEN vector_score WHEN 'lexical' THEN lexical_score ELSE rrf_score END" if choices else "rrf_score"
    score = "CASE WHEN q.mode = 'hybrid' THEN rrf_score ELSE 0.0::DOUBLE END" if choices else "rrf_score"
    switch = " AND h.query_id % 3 <> 1" if choices else ""
    return f"""WITH limits AS MATERIALIZED ({_ASKED}),
      seen AS MATERIALIZED (
        SELECT s.query_id, s.chunk_id, s.sim, NULL::DOUBLE AS lexical, row_number() OVER (PARTITION BY s.query_id ORDER BY s.sim DESC, s.chunk_id) AS r
        FROM sims s JOIN limits q USING (query_id) JOIN owned c USING (chunk_id) WHERE {sides[0]}{_VISIBLE} QUALIFY r <= any_value(q.ck) OVER (PARTITION BY s.query_id)
        UNION ALL
        SELECT s.query_id, s.chunk_id, NULL, s.lexical, row_number() OVER (PARTITION BY s.query_id ORDER BY s.lexical DESC, s.chunk_id) AS r
        FROM lexical s JOIN limits q USING (query_id) JOIN owned c USING (chunk_id) WHERE {sides[1]}{_VISIBLE} QUALIFY r <= any_value(q.ck) OVER (PARTITION BY s.query_id)),
      joined AS MATERIALIZED (
        SELECT query_id, chunk_id, coalesce(max(sim), 0.0::DOUBLE) AS vector_score, coalesce(max(lexical), 0.0::DOUBLE) AS lexical_score,
               round(sum(1.0::DOUBLE / (60 + r)), 10) AS rrf_score FROM seen GROUP BY query_id, chunk_id),
      best AS MATERIALIZED (
        SELECT j.query_id, j.chunk_id, vector_score, lexical_score, {score} AS rrf_score, q.tk,
               row_number() OVER (PARTITION BY j.query_id ORDER BY {order} DESC, j.chunk_id) AS rnk
        FROM joined j JOIN limits q USING (query_id) QUALIFY rnk <= any_value(q.ck) OVER (PARTITION BY j.query_id))
      SELECT query_id, 'S' || position AS sid, chunk_id AS id, nullif(rerank_score, 0) AS rerank_score, vector_score, lexical_score, rrf_score FROM (
        SELECT b.*, row_number() OVER (PARTITION BY b.query_id ORDER BY rerank_score DESC NULLS LAST, b.rnk) AS position FROM (
          SELECT h.*, CASE WHEN count(*) OVER (PARTITION BY h.query_id) > 1{switch} THEN
              CASE WHEN len(w.terms) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(w.terms, k.toks)) / len(w.terms)::DOUBLE, 6) END END AS rerank_score
          FROM best h JOIN query_words w USING (query_id) JOIN chunk_words k USING (chunk_id)) b
        QUALIFY position <= b.tk)"""


_SOURCES = ["query_id", "sid", "id", "rerank_score", "vector_score", "lexical_score", "rrf_score"]


@query("R10_R14_retrieve", ctes(_retrieved(choices=False)))
def retrieve(spark, d):
    """The whole way from questions to source rows, with each question's own limits and scope."""
    from corpusflow.plans import answer

    chunks = written(derive.search_chunks(spark, d))
    return flat(answer.retrieve(derive.questions(spark, d), chunks, derive.sessions(spark, d)).select(*_SOURCES))


def _choosing(spark, d):
    """Questions of all modes, a third of them without rerank."""
    return derive.questions(spark, d).withColumn("rerank", F.col("query_id") % 3 != 1)


@query("R11_R13_choices", ctes(_retrieved(choices=True)))
def own_choices(spark, d):
    """The whole way again, each question with its own mode and rerank switch."""
    from corpusflow.plans import answer

    found = answer.retrieve(_choosing(spark, d), derive.search_chunks(spark, d), derive.sessions(spark, d), choices=True)
    return flat(found.select(*_SOURCES))


@query("R11_R13_choices_stored", ctes(_retrieved(choices=True)))
def own_choices_stored(spark, d):
    """The same from the stored index, looking into every cell."""
    from corpusflow.plans import answer

    path, sessions = fresh_dir(spark, "served"), derive.sessions(spark, d)
    chunks = written(derive.search_chunks(spark, d))
    centres = index.mean_centres(chunks.withColumn("language", F.col("metadata.language")), "language")
    index.build_cells(filters.with_owner(chunks, sessions), path, centres)
    index.build_postings_store(chunks, path, parts=16)
    served = answer.Served(path, probes=len(centres.centres), parts=16)
    return flat(answer.retrieve(_choosing(spark, d), chunks, sessions, choices=True, served=served).select(*_SOURCES))


@query("R17_kept_results", SQL["R10_R14_retrieve"])
def kept_results(spark, d):
    """Half of the questions are answered and kept; then all are asked, the kept ones once more over an empty corpus."""
    from corpusflow.plans import answer
    from corpusflow.session import settled

    chunks, sessions, store = written(derive.search_chunks(spark, d)), derive.sessions(spark, d), fresh_dir(spark, "results")
    questions = settled(derive.questions(spark, d).drop("mode", "session_id", "item_id"))
    columns = ["query_id", "sid", "id", "rerank_score", "vector_score", "lexical_score", "rrf_score"]
    for minute, asked, corpus_now in ((0, questions.filter("query_id % 2 = 0"), chunks), (1, questions, chunks), (2, questions, chunks.limit(0))):
        now = derive.as_of() + F.expr(f"INTERVAL {minute} MINUTES")
        found = answer.retrieve_kept(asked, corpus_now, sessions, store, now)
    return flat(found.select(*columns))


@query("R15_snippet", f"SELECT doc_id, {sqlkit.snippet('text')} AS snippet FROM documents")
def snippet(spark, d):
    from corpusflow.functions import text as tx

    return derive.given(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query(
    "R16_parse_metadata",
    ctes("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN (json_extract_string(props, '$.k'))::BIGINT END AS k,
              event_id % 4 < 2 AS is_object FROM events"""),
)
def parse_metadata(spark, d):
    e = F.col("event_id")
    raw = (
        F.when(e % 4 < 2, F.col("props"))
        .when(e % 4 == 2, F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .otherwise(F.concat(F.lit("{"), F.col("props")))
    )
    parsed = derive.given(spark, d, "events").select("event_id", fusion.parse_metadata(raw).alias("m"))
    return parsed.select(
        "event_id",
        F.try_variant_get("m", "$.k", "bigint").alias("k"),
        (F.to_json("m") != "{}").alias("is_object"),
    )


@query(
    "R17_reuse_results",
    ctes(f"""WITH asks AS MATERIALIZED (SELECT event_id AS query_id, ts, lower(trim(event_type)) || user_id % 20 AS k FROM events),
               prior AS (SELECT DISTINCT event_type || user_id % 20 AS k FROM events
                         WHERE ts <= TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-20' - INTERVAL 12 HOUR)
             SELECT query_id, k IN (SELECT k FROM prior) AS cached,
                    k NOT IN (SELECT k FROM prior) AND query_id = min(query_id) OVER (PARTITION BY k) AS run FROM asks"""),
)
def reuse_results(spark, d):
    """Every event asks for its type; what was asked in the last hours is reused."""
    events = derive.events(spark, d)
    user = F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string"))
    asks = events.select(
        F.col("event_id").alias("query_id"),
        F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")).alias("text"),
        user.alias("user_id"),
    )
    earlier = events.select(F.col("event_type").alias("text"), user.alias("user_id"), F.col("ts").alias("created_at"))
    prior = earlier.withColumn("key", fusion.query_key(earlier)).select("key", "created_at")
    now = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return fusion.reuse_results(asks, prior, now, 12 * 3600).select("query_id", "cached", "run")


# ---- rewriting and whole-document requests ---------------------------------

_ROOMS = r"""list_reduce(list_prepend('', list_transform(list_zip(regexp_split_to_array({e}, '{p}'), regexp_extract_all({e}, '{p}', 0), regexp_extract_all({e}, '{p}', 1)),
    lambda x: x[1] || CASE WHEN x[3] IS NULL THEN '' WHEN x[3]::BIGINT >= 1 THEN (x[3]::BIGINT - 1) || '-bedroom' ELSE x[2] END)), lambda a, b: a || b)"""
_AZ = r"([0-9]+)\s*[-\s]?\s*(?i:otaq)(?i:lı|li)?"
_RU = r"([0-9]+)\s*[-\s]?\s*(?i:комнатн)(?i:ая|ой|ую|ые|ых)?"


@query(
    "R18_rewrite_rooms",
    ctes(f"""SELECT url, rewritten, rewritten <> markdown AS changed FROM (
               SELECT url, markdown, {_ROOMS.format(e='az', p=_RU)} AS rewritten FROM (
                 SELECT url, markdown, {_ROOMS.format(e='markdown', p=_AZ)} AS az FROM listings))"""),
)
def rewrite_rooms(spark, d):
    rows = derive.listings(spark, d).select("url", F.col("markdown").alias("text"))
    return context.rewrite_rooms(rows).select("url", "rewritten", "changed")


_VERB = r"(?i)\b(analy[sz]e|summari[sz]e|review|brief|tl;?dr|overview|describe|extract|explain|tell me about|what(?: is|\x27s) (?:in|this))\b"
_TARGET = r"(?i)\b(this|the|uploaded|attached|my) (doc(?:ument)?|file|pdf|brochure|contract|report|paper|tender|offer|spec|boq)\b"
_WHAT = r"(?i)^\s*what\b.*\b(doc(?:ument)?|file|pdf|brochure|contract)\b"
_LEADS = ["", "Summarize this document: ", "review ", "What does the contract say about ", "Explain why ", "the report on "]


@query(
    "R19_is_meta_doc",
    f"""SELECT conv_id, turn, (regexp_matches(q, '{_VERB}') AND (regexp_matches(q, '{_TARGET}') OR length(q) <= 80)) OR regexp_matches(q, '{_WHAT}') AS meta_doc
        FROM (SELECT conv_id, turn, {sqlkit.trim_blank(f"list_extract({_LEADS!r}, 1 + (conv_id + turn) % 6) || text")} AS q FROM conversations)""",
)
def is_meta_doc(spark, d):
    leads = F.array(*[F.lit(x) for x in _LEADS])
    lead = F.get(leads, ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    rows = derive.given(spark, d, "conversations")
    return rows.select("conv_id", "turn", context.is_meta_doc(F.concat(lead, F.col("text"))).alias("meta_doc"))


@query(
    "R20_stride_sample",
    ctes("""SELECT doc_id, chunk_index, pos, n FROM (
              SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks)
            WHERE n <= 8 OR list_contains(list_transform(range(0, 8), lambda i: floor(i * ((n - 1) / 7.0::DOUBLE) + 0.5)::BIGINT), pos)"""),
)
def stride_sample(spark, d):
    chunks = derive.paragraph_chunks(spark, d).select("doc_id", "chunk_index")
    return flat(context.stride_sample(chunks, ["doc_id"], ["chunk_index"], 8))


_PICKED = """
  SELECT q.query_id, x.pos, x.chunk_id, x.origin FROM requests q JOIN (
    SELECT 'session' AS origin, session_id AS key, chunk_id, row_number() OVER (PARTITION BY session_id ORDER BY doc_id, chunk_index) - 1 AS pos,
           count(*) OVER (PARTITION BY session_id) AS n FROM chunks WHERE session_id IS NOT NULL
    UNION ALL
    SELECT 'user', owner, chunk_id, row_number() OVER (PARTITION BY owner ORDER BY doc_id, chunk_index) - 1, count(*) OVER (PARTITION BY owner)
    FROM owned WHERE owner IS NOT NULL) x
  ON x.key = CASE WHEN q.session_id IN (SELECT session_id FROM chunks WHERE session_id IS NOT NULL) THEN q.session_id ELSE q.user_id END
     AND x.origin = CASE WHEN q.session_id IN (SELECT session_id FROM chunks WHERE session_id IS NOT NULL) THEN 'session' ELSE 'user' END
  WHERE n <= lim OR list_contains(list_transform(range(0, lim), lambda i: floor(i * ((n - 1) / (lim - 1)::DOUBLE) + 0.5)::BIGINT), x.pos)"""


@query(
    "R21_doc_chunks",
    ctes("""WITH requests AS MATERIALIZED (SELECT conv_id * 100 + turn AS query_id, 'u' || (conv_id % 20) AS user_id,
                CASE WHEN turn % 2 = 0 THEN conv_id::VARCHAR ELSE 'none' END AS session_id, greatest(8, least(20, greatest(1, turn * 4))) AS lim FROM conversations)"""
         + _PICKED),
)
def doc_chunks(spark, d):
    conv, turn = F.col("conv_id"), F.col("turn")
    requests = derive.given(spark, d, "conversations").select(
        (conv * 100 + turn).alias("query_id"),
        F.concat(F.lit("u"), (conv % 20).cast("string")).alias("user_id"),
        F.when(turn % 2 == 0, conv.cast("string")).otherwise("none").alias("session_id"),
        (turn * 4).alias("top_k"),
    )
    picked = context.doc_chunks(derive.paragraph_chunks(spark, d), derive.sessions(spark, d), requests)
    return flat(picked.select("query_id", "pos", "chunk_id", "origin"))


# ---- prompt text -----------------------------------------------------------


@query(
    "R22_format_facts",
    ctes("""SELECT l.url, ' extracted_facts={' || concat_ws(', ', 'price=' || round(p_retailprice * 1000)::BIGINT || ' ' || CASE p_size % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'AZN' END,
              CASE WHEN p_partkey % 3 = 0 THEN 'bedrooms=' || (1 + p_size % 5) END, CASE WHEN p_partkey % 3 <> 2 THEN 'bathrooms=' || (1 + p_size % 3) END,
              'area_sqm=' || (40 + p_size * 3), 'property_type=' || CASE p_size % 4 WHEN 0 THEN 'apartment' WHEN 1 THEN 'villa' WHEN 2 THEN 'office' ELSE 'retail' END,
              'listing_type=' || CASE WHEN p_size % 2 = 1 THEN 'sale' ELSE 'rent' END, 'location="' || n_name || '"') || '}' AS facts
            FROM listings l JOIN part ON p_partkey = l.doc_no LEFT JOIN nation ON n_nationkey = p_partkey % 25"""),
)
def format_facts(spark, d):
    from corpusflow.operators import corpus

    listings = corpus.with_facts(derive.listings(spark, d))
    return listings.select("url", context.format_facts(F.col("metadata")).alias("facts"))


_BLOCKS = f"""SELECT query_id, string_agg('[S' || position || '] type=' || doc_type || ' lang=' || language || ' url=' || url || chr(10) || content,
                chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS sources_block FROM ({_POSITIONED}) GROUP BY query_id"""


@query("R24_sources_block", ctes(_BLOCKS))
def sources_block(spark, d):
    return context.sources_block(fusion.shape_sources(_reranked(spark, d)))


@query(
    "R25_build_prompts",
    ctes(f"""SELECT q.query_id, concat_ws(chr(10), 'PROFILE of ' || q.user_id, CASE WHEN q.query_id % 2 = 0 THEN 'MEMORY for ' || q.query_id END,
               'Question: ' || q.text, 'Sources:', b.sources_block) AS prompt FROM questions q JOIN ({_BLOCKS}) b USING (query_id)"""),
)
def build_prompts(spark, d):
    queries = derive.questions(spark, d)
    blocks = context.sources_block(fusion.shape_sources(_reranked(spark, d)))
    # Blocks stand in for the memory and profile texts, whose own queries are S11.
    memories = queries.select(
        "query_id",
        F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("MEMORY for "), F.col("query_id").cast("string")))
        .otherwise("").alias("memories_block"),
    )
    users = queries.filter("user_id IS NOT NULL").select("user_id").distinct()
    profiles = users.select("user_id", F.concat(F.lit("PROFILE of "), F.col("user_id")).alias("profile_block"))
    return context.build_prompts(queries, blocks, memories, profiles)


@query(
    "R26_trace_chunks",
    ctes("SELECT c.doc_id, c.url AS page_url, c.chunk_index, sha256(c.content) AS content_hash FROM chunks c"),
)
def trace_chunks(spark, d):
    docs = derive.documents(spark, d)
    urls = docs.select("url")
    traced = context.trace_many(derive.paragraph_chunks(spark, d).drop("url"), docs, urls)
    return flat(traced.select("doc_id", "page_url", "chunk_index", F.sha2("content", 256).alias("content_hash")))


@query(
    "R26_stored_lookup",
    ctes("SELECT doc_id, chunk_index, sha256(content) AS content_hash FROM chunks WHERE doc_id IN (SELECT doc_id FROM chunks WHERE contains(content, 'license'))"),
)
def stored_lookup(spark, d):
    """All chunks of the documents that mention a word, by point lookups in the stored table."""
    path = fresh_dir(spark, "lookups")
    chunks = derive.paragraph_chunks(spark, d)
    tables.write_chunks(chunks.select("doc_id", "chunk_index", "content"), path, buckets=16)
    found = tables.lookup(spark, path, chunks.filter(F.col("content").contains("license")).select("doc_id"), buckets=16)
    return flat(found.select("doc_id", "chunk_index", F.sha2("content", 256).alias("content_hash")))


@query(
    "R27_no_context",
    ctes(f"SELECT query_id, '{context.NO_CONTEXT_ANSWER}' AS answer, 'none' AS mode FROM questions WHERE query_id NOT IN (SELECT query_id FROM matched)"),
)
def no_context(spark, d):
    queries = derive.questions(spark, d)
    chunks = lexical.with_tokens(derive.paragraph_chunks(spark, d))
    return context.no_context(queries, lexical.lexical_search(queries, chunks, 32))
