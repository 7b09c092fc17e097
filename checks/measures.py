"""Usage analytics and evaluation (A, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derive, sqlkit
from checks.registry import flat, query
from checks.retrieval import _CELLS, _in_cells, _labelled, _vector_tables
from checks.sqlkit import CTES, ctes, seconds, similarity
from corpusflow.operators import encode, evaluation, fusion, lexical, memory, usage, vector
from corpusflow.session import fits_broadcast, written
from corpusflow.sources import tables
from corpusflow.streaming.run import fresh_dir

# ---- usage -----------------------------------------------------------------


@query(
    "A1_top_cited",
    ctes("SELECT chunk_id, count(*) AS citations FROM (SELECT unnest(sources) AS chunk_id FROM messages WHERE role = 'assistant') GROUP BY 1 ORDER BY citations DESC, chunk_id LIMIT 20"),
)
def top_cited(spark, d):
    return usage.top_cited(derive.messages(spark, d))


@query("A2_cited_in", ctes("SELECT id, session_id, substr(content, 1, 80) AS preview FROM messages WHERE role = 'assistant' AND list_contains(sources, 14)"))
def cited_in(spark, d):
    return usage.cited_in(derive.messages(spark, d), 14)


CTES["usage_"] = """
  SELECT id, session_id, json_extract_string(metadata, '$.model') AS model, (metadata->'$.usage.input_tokens')::BIGINT AS in_tok,
    (metadata->'$.usage.output_tokens')::BIGINT AS out_tok, (metadata->'$.usage.cache_read_input_tokens')::BIGINT AS cache_read,
    json_extract_string(metadata, '$.retrieval.mode') AS retrieval_mode, json_extract_string(metadata, '$.retrieval.reranked') = 'true' AS reranked, created_at
  FROM messages WHERE role = 'assistant'"""


@query("A4_turn_usage", ctes(f"SELECT * REPLACE ({seconds('created_at')} AS created_at) FROM usage_"))
def turn_usage(spark, d):
    return flat(usage.turn_usage(derive.messages(spark, d)))


@query("A4_latest_usage", ctes(f"SELECT * REPLACE ({seconds('created_at')} AS created_at) FROM usage_ ORDER BY usage_.created_at DESC, id LIMIT 50"))
def latest_usage(spark, d):
    return flat(usage.turn_usage(derive.messages(spark, d), latest=50))


# Rates per million tokens by model, derived from the models that occur.
@query(
    "A5_usage_cost",
    ctes("""SELECT strftime(day, '%Y-%m-%d') AS day, model, turns, in_tok, out_tok, cache_read,
              round((in_tok * ir + out_tok * (ir * 5) + cache_read * (ir / 10)) / 1e6::DOUBLE, 6) AS cost,
              round(CASE WHEN in_tok + cache_read > 0 THEN cache_read / (in_tok + cache_read)::DOUBLE END, 6) AS cached_share
            FROM (SELECT created_at::DATE AS day, model, count(*) AS turns, sum(in_tok)::BIGINT AS in_tok, sum(out_tok)::BIGINT AS out_tok, sum(cache_read)::BIGINT AS cache_read,
                    (1 + substr(model, 2)::BIGINT)::DOUBLE AS ir FROM usage_ GROUP BY 1, 2)"""),
)
def usage_cost(spark, d):
    turns = usage.turn_usage(derive.messages(spark, d))
    base = (1 + F.substring("model", 2, 5).cast("int")).cast("double")
    rates = turns.select("model").distinct().select(
        "model", base.alias("input_rate"), (base * 5).alias("output_rate"), (base / 10).alias("cached_rate")
    )
    return flat(usage.usage_cost(turns, rates))


@query(
    "A6_extract_citations",
    ctes(r"""SELECT id, unnest(range(len(found))) AS citation_index, unnest(found)::BIGINT AS cited
             FROM (SELECT id, regexp_extract_all(content, '\[S(\d+)\]', 1) AS found FROM messages)"""),
)
def extract_citations(spark, d):
    return flat(usage.extract_citations(derive.messages(spark, d).select("id", "content")).drop("content"))


def _case(column: str, values: dict) -> str:
    arms = " ".join(f"WHEN {k if isinstance(k, int) else repr(k)} THEN '{v}'" for k, v in values.items())
    return f"CASE {column} {arms} END"


_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
CTES["error_kinds"] = f"""
  SELECT *, CASE WHEN name IN {_IN(usage.ABORT_NAMES)} THEN 'aborted'
      WHEN status = 400 AND regexp_matches(message, '{usage.BILLING}') THEN 'billing'
      WHEN (status IS NOT NULL OR name LIKE '%Error') AND mapped IN {_IN(usage.PROVIDER_KINDS)} THEN mapped
      WHEN name IN {_IN(usage.TIMEOUT_NAMES)} OR code IN {_IN(usage.TIMEOUT_CODES)} THEN 'timeout'
      WHEN name IN {_IN(usage.NETWORK_NAMES)} OR code IN {_IN(usage.NETWORK_CODES)} THEN 'network'
      WHEN regexp_matches(code, '{usage.DB_CODE}') THEN 'db' ELSE 'unknown' END AS kind
  FROM (SELECT *, coalesce({_case('type', usage.ERROR_TYPES)}, {_case('status', usage.ERROR_STATUS)},
          CASE WHEN status >= 500 THEN 'server' WHEN status >= 400 THEN 'validation' END) AS mapped FROM error_log)"""


@query(
    "A7_classify_errors",
    ctes(f"""SELECT id, kind, kind IN {_IN(usage.RETRYABLE)} AS retryable,
               CASE WHEN kind IN ('billing', 'unknown') OR kind IN {_IN(usage.PROVIDER_KINDS)} THEN status END::BIGINT AS reported_status FROM error_kinds"""),
)
def classify_errors(spark, d):
    return flat(usage.classify_errors(derive.error_log(spark, d)).select("id", "kind", "retryable", "reported_status"))


@query(
    "A8_redact",
    ctes("SELECT event_id, event_type || '=' || value::VARCHAR AS kept FROM events"),
)
def redact(spark, d):
    rows = derive.events(spark, d).select(
        "event_id",
        F.col("props").alias("token"),
        F.create_map(
            F.lit("password"), F.lit("p"), F.col("event_type"), F.col("value").cast("string"), F.lit("cookie"), F.col("props")
        ).alias("fields"),
    )
    safe = usage.redact(rows)
    shown = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return safe.select("event_id", F.array_join(shown, ",").alias("kept"), *[c for c in safe.columns if c == "token"])


@query(
    "A10_over_limit",
    f"""SELECT user_id % 3 AS user_id, {seconds("to_timestamp(epoch_us(ts) // 60000000 * 60)::TIMESTAMP")} AS window_start, count(*) AS requests
        FROM events GROUP BY 1, epoch_us(ts) // 60000000 HAVING count(*) > 1""",
)
def over_limit(spark, d):
    events = derive.events(spark, d).withColumn("user_id", F.col("user_id") % 3)
    return flat(usage.over_limit(events, most=1))


# ---- evaluation ------------------------------------------------------------

CTES["eval_sims"] = f"SELECT q.query_id, c.chunk_id, {similarity('q.vec', 'c.vec')} AS sim FROM eval_vectors q CROSS JOIN chunk_vectors c"
CTES["eval_hits"] = """
  SELECT s.query_id::VARCHAR AS id, s.chunk_id, c.content, row_number() OVER (PARTITION BY s.query_id ORDER BY s.sim DESC, s.chunk_id) AS position
  FROM eval_sims s JOIN chunks c USING (chunk_id) QUALIFY position <= 8"""
# Answers: the turns of a conversation, each citing some sources.
CTES["answers"] = """
  SELECT q.id, q.no_match_expected, CASE WHEN q.query_id % 3 = 0 THEN 'I could not find it in the sources. ' ELSE '' END || q.text
    || ' [S' || (1 + q.query_id % 11) || '][S2]' AS answer, list_slice(q.must_match, 1, 1) || ['never said'] AS should_not_invent
  FROM eval_questions q"""


def _eval_hits(spark, d, chunks=None):
    asked = encode.embed(derive.eval_questions(spark, d), "text", dim=derive.DIM, side="query")
    chunks = derive.search_chunks(spark, d) if chunks is None else chunks
    near = fusion.vector_hits(asked, chunks, 8).select(
        "query_id", F.col("item_id").alias("chunk_id"), F.col("rank").alias("position")
    )
    fits = fits_broadcast(asked, rows_each=8)
    return fusion.attach_chunks(near, chunks, ["content"], fits=fits).withColumn("id", F.col("query_id").cast("string"))


def _answers(spark, d):
    q = F.col("query_id")
    return derive.eval_questions(spark, d).select(
        "id",
        "no_match_expected",
        F.concat(
            F.when(q % 3 == 0, "I could not find it in the sources. ").otherwise(""), "text",
            F.lit(" [S"), (1 + q % 11).cast("string"), F.lit("][S2]"),
        ).alias("answer"),
        F.concat(F.slice("must_match", 1, 1), F.array(F.lit("never said"))).alias("should_not_invent"),
    )


_RECALLED = """
  SELECT q.id, coalesce(bool_or(len(list_filter(q.must_match, lambda k: contains(lower(h.content), lower(k)))) > 0), false) AS retrieval_recall
  FROM eval_questions q LEFT JOIN {} h USING (id) WHERE len(q.must_match) > 0 GROUP BY q.id"""


@query("E1_retrieval_recall", ctes(_RECALLED.format("eval_hits")))
def retrieval_recall(spark, d):
    return evaluation.retrieval_recall(derive.eval_questions(spark, d), _eval_hits(spark, d))


@query(
    "E2_citation_validity",
    ctes(r"""SELECT a.id, count(DISTINCT c) AS citations, count(DISTINCT c) FILTER (h.id IS NULL) AS invalid, count(DISTINCT c) FILTER (h.id IS NULL) = 0 AS citations_valid
             FROM (SELECT id, unnest(regexp_extract_all(answer, '\[S(\d+)\]', 1))::BIGINT AS c FROM answers) a LEFT JOIN eval_hits h ON h.id = a.id AND h.position = a.c GROUP BY a.id"""),
)
def citation_validity(spark, d):
    return evaluation.citation_validity(_answers(spark, d), _eval_hits(spark, d))


_REFUSED = (
    f"regexp_matches(substr({sqlkit.trim_blank('answer')}, 1, 500), "
    f"'{sqlkit.word('|'.join(memory.REFUSALS), open_end=True).replace(chr(39), chr(39) * 2)}')"
)


@query("E3_refusal_check", ctes(f"SELECT id, CASE WHEN no_match_expected THEN {_REFUSED} END AS refusal_correct FROM answers"))
def refusal_check(spark, d):
    return evaluation.refusal_check(_answers(spark, d))


@query("E4_forbidden_check", ctes("SELECT id, len(list_filter(should_not_invent, lambda k: contains(lower(answer), lower(k)))) > 0 AS invented FROM answers"))
def forbidden_check(spark, d):
    return evaluation.forbidden_check(_answers(spark, d))


_RATES = ", ".join(
    f"count(*) FILTER ({m}) AS {m}_pass, count({m}) AS {m}_total" for m in evaluation.METRICS
)


def _flags(spark, d):
    return evaluation.judged(derive.judge_scores(spark, d))


@query("E5_eval_summary", ctes(f"SELECT {_RATES}, round(avg(latency), 6) AS avg_latency FROM flags"))
def eval_summary(spark, d):
    return evaluation.eval_summary(_flags(spark, d))


@query("E6_eval_breakdown", ctes(f"SELECT category, language, {_RATES} FROM flags GROUP BY GROUPING SETS ((category, language), (category), (language))"))
def eval_breakdown(spark, d):
    return evaluation.eval_breakdown(_flags(spark, d))


@query(
    "E7_eval_failures",
    ctes(" UNION ALL ".join(
        f"SELECT id, '{m}' AS metric, {'faithful_reason' if m == 'faithful' else 'NULL::VARCHAR'} AS reason FROM flags WHERE NOT {m}"
        for m in evaluation.METRICS
    )),
)
def eval_failures(spark, d):
    return evaluation.eval_failures(_flags(spark, d))


def _sql_metrics(where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(count(*) FILTER ({m}) / nullif(count({m}), 0)::DOUBLE, 6) AS rate FROM flags WHERE {where}"
        for m in evaluation.METRICS
    )


@query(
    "E8_eval_gate",
    ctes(f"""SELECT metric, c.rate, p.rate AS before, round(CASE WHEN p.rate > 0 THEN (p.rate - c.rate) / p.rate END, 6) AS drop,
               coalesce(round(CASE WHEN p.rate > 0 THEN (p.rate - c.rate) / p.rate END, 6) > 0.05, false) AS regressed
             FROM ({_sql_metrics("language = 'en'")}) c JOIN ({_sql_metrics("language <> 'en'")}) p USING (metric)"""),
)
def eval_gate(spark, d):
    """The run over English questions against the run over the other languages."""
    flags = _flags(spark, d)
    now = evaluation.as_metrics(evaluation.eval_summary(flags.filter("language = 'en'")))
    before = evaluation.as_metrics(evaluation.eval_summary(flags.filter("language != 'en'")))
    return evaluation.eval_gate(now, before)


CTES["eval_words"] = f"SELECT query_id, list_distinct({sqlkit.tokens('text')}) AS terms FROM eval_questions"
CTES["eval_matched"] = """
  SELECT q.query_id::VARCHAR AS id, p.chunk_id FROM (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM eval_words) q JOIN postings p USING (term)
  GROUP BY q.query_id, p.chunk_id, q.n HAVING count(DISTINCT p.term) = q.n"""
# Word search by the first long word of a question.
CTES["keyword_hits"] = """
  SELECT q.id, p.chunk_id, c.content, row_number() OVER (PARTITION BY q.id ORDER BY count(*) DESC, p.chunk_id) AS position
  FROM eval_questions q JOIN postings p ON p.term = q.must_match[1] JOIN chunks c USING (chunk_id) GROUP BY q.id, p.chunk_id, c.content QUALIFY position <= 8"""


@query(
    "E9_compare_modes",
    ctes(f"""SELECT mode, count(*) AS questions, count(*) FILTER (retrieval_recall) AS passed, round(avg(retrieval_recall::INT), 6) AS recall FROM (
               SELECT 'vector' AS mode, retrieval_recall FROM ({_RECALLED.format('eval_hits')}) UNION ALL
               SELECT 'lexical', retrieval_recall FROM ({_RECALLED.format('keyword_hits')})) GROUP BY mode"""),
)
def compare_modes(spark, d):
    questions = derive.eval_questions(spark, d)
    keyword = questions.select("query_id", F.get("must_match", F.lit(0)).alias("text")).filter("text IS NOT NULL")
    # Words and vectors of all chunks once, for both searches; encoder and scan run one after the other.
    chunks = written(derive.search_chunks(spark, d))
    worded = lexical.lexical_search(keyword, chunks, 8)
    fits = fits_broadcast(keyword, rows_each=8)
    hits = fusion.attach_chunks(worded, chunks, ["content"], fits=fits).withColumn("id", F.col("query_id").cast("string"))
    return evaluation.compare_modes(
        {
            "vector": evaluation.retrieval_recall(questions, _eval_hits(spark, d, chunks)),
            "lexical": evaluation.retrieval_recall(questions, hits),
        }
    )


@query(
    "E10_ann_recall",
    f"""{_CELLS}, a AS ({_in_cells('8')} QUALIFY rank <= 10), x AS ({_in_cells('10')} QUALIFY rank <= 10)
        SELECT round(avg(CASE WHEN a.item_id IS NULL THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS recall, count(*) AS pairs
        FROM x LEFT JOIN a USING (query_id, item_id)""",
)
def ann_recall(spark, d):
    queries, items = _vector_tables(spark, d)
    exact = vector.knn(queries, items, 10)
    return flat(vector.ann_recall(exact, vector.knn_approx(queries, items, 10, cells=_labelled(spark, d), probes=8)))


@query(
    "E11_balanced_split",
    ctes("""SELECT id, category, CASE WHEN ('0x' || substr(md5(id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.25 THEN 'held_out' ELSE 'train' END AS split,
              row_number() OVER (PARTITION BY category ORDER BY md5(id), id) AS position FROM scores QUALIFY position <= 12"""),
)
def balanced_split(spark, d):
    scores = derive.judge_scores(spark, d).select("id", "category")
    return flat(evaluation.balanced_split(scores, 12, 0.25))


@query(
    "E12_majority_vote",
    ctes("""SELECT id, count(*) FILTER (p) AS ayes, count(p) AS votes, count(*) FILTER (p) * 2 > count(p) AS passed
            FROM (SELECT id, faithful AS p FROM flags UNION ALL SELECT id, relevant FROM flags UNION ALL SELECT id, citations_valid FROM flags) GROUP BY id"""),
)
def majority_vote(spark, d):
    flags = _flags(spark, d)
    judges = [flags.select("id", F.col(m).alias("passed")) for m in ("faithful", "relevant", "citations_valid")]
    return evaluation.majority_vote(judges[0].unionByName(judges[1]).unionByName(judges[2]))


# ---- report and statistics -------------------------------------------------


@query(
    "I6_write_report",
    ctes(" UNION ALL ".join(
        f"SELECT 'failure' AS part, '{m}' AS metric, count(*) AS rows FROM flags WHERE NOT {m} HAVING count(*) > 0" for m in evaluation.METRICS
    ) + " UNION ALL " + " UNION ALL ".join(f"SELECT 'metric', '{m}', 1" for m in evaluation.METRICS)),
)
def write_report(spark, d):
    flags = _flags(spark, d)
    path = fresh_dir(spark, "report")
    tables.write_report(
        evaluation.as_metrics(evaluation.eval_summary(flags)), evaluation.eval_failures(flags), path
    )
    metrics = spark.read.schema("metric string, rate double").json(f"{path}/metrics")
    failures = spark.read.schema("id string, metric string, reason string").json(f"{path}/failures")
    rows = metrics.select(F.lit("metric").alias("part"), "metric").unionByName(
        failures.select(F.lit("failure").alias("part"), "metric")
    )
    return rows.groupBy("part", "metric").agg(F.count(F.lit(1)).alias("rows"))


@query("I9_refresh_stats", "SELECT 'analyzed_documents' AS \"table\", count(*) AS rows FROM documents")
def refresh_stats(spark, d):
    path = fresh_dir(spark, "analyzed")
    derive.documents(spark, d).write.mode("overwrite").option("path", path).saveAsTable("analyzed_documents")
    return tables.refresh_stats(spark, ["analyzed_documents"])
