"""Incremental load (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derive, sqlkit
from checks.preparation import sql_chunks
from checks.registry import flat, query
from checks.sqlkit import CTES, ctes
from corpusflow.functions import keys
from corpusflow.functions import text as tx
from corpusflow.operators import corpus, load
from corpusflow.plans import ingest
from corpusflow.session import written
from corpusflow.sources import tables
from corpusflow.streaming.run import fresh_dir

# The earlier load: the labelled documents. Toxic ones had one more paragraph at
# the end, those of low quality another text in front.
CTES["old_corpus"] = """
  SELECT c.* REPLACE (CASE WHEN quality = 0 THEN 'Draft.' || chr(10) || chr(10) ELSE '' END || c.markdown
    || CASE WHEN toxic = 1 THEN chr(10) || chr(10) || 'Removed later.' ELSE '' END AS markdown)
  FROM corpus c JOIN labels l ON l.doc_id = c.doc_no"""
CTES["old_bodies"] = f"SELECT *, {sqlkit.normalize('markdown')} AS body FROM old_corpus"
CTES["old_chunks"] = f"""
  SELECT doc_no, doc_id, ord AS chunk_index, content FROM (
    SELECT doc_no, doc_id, unnest(parts) AS content, unnest(range(len(parts))) AS ord
    FROM (SELECT *, {sqlkit.paragraphs('body')} AS parts FROM old_bodies))"""
CTES["chunk_states"] = """
  SELECT doc_id, chunk_index, n.content AS new_content, o.content AS old_content,
         CASE WHEN o.content IS NULL THEN 'new' WHEN n.content IS NULL THEN 'removed' WHEN o.content = n.content THEN 'unchanged' ELSE 'changed' END AS status
  FROM (SELECT doc_id, chunk_index, content FROM chunks) n FULL JOIN old_chunks o USING (doc_id, chunk_index)"""


def _old_corpus(spark, d):
    labels = derive.given(spark, d, "labels").withColumnRenamed("doc_id", "doc_no")
    front = F.when(F.col("quality") == 0, "Draft.\n\n").otherwise("")
    back = F.when(F.col("toxic") == 1, "\n\nRemoved later.").otherwise("")
    return (
        derive.corpus(spark, d).join(labels, "doc_no")
        .withColumn("markdown", F.concat(front, "markdown", back)).drop("quality", "toxic")
    )


def _documents(records):
    return corpus.normalize(records).select("doc_id", "body", keys.content_hash(F.col("body")).alias("source_hash"))


def _paragraph_rows(records):
    body = corpus.normalize(records)
    return corpus.split_into(body, tx.paragraphs(F.col("body")), "chunk_index", "content").select(
        "doc_id", "chunk_index", "content", keys.content_hash(F.col("content")).alias("content_hash")
    )


@query(
    "U1_diff_documents",
    ctes("""SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.body = n.body THEN 'unchanged' ELSE 'changed' END AS status
            FROM bodies n LEFT JOIN old_bodies o USING (doc_id)"""),
)
def diff_documents(spark, d):
    new, old = _documents(derive.corpus(spark, d)), _documents(_old_corpus(spark, d))
    return load.diff_documents(new, old).select("doc_id", "status")


@query("U2_diff_chunks", ctes("SELECT doc_id, chunk_index, status FROM chunk_states"))
def diff_chunks(spark, d):
    return flat(load.diff_chunks(_paragraph_rows(derive.corpus(spark, d)), _paragraph_rows(_old_corpus(spark, d))))


@query(
    "U3_load_stats",
    ctes("""SELECT count(*) FILTER (status = 'new') AS inserted, count(*) FILTER (status = 'changed') AS updated,
              count(*) FILTER (status = 'unchanged') AS skipped_unchanged, count(*) FILTER (status = 'removed') AS pruned FROM chunk_states"""),
)
def load_stats(spark, d):
    return load.load_stats(
        load.diff_chunks(_paragraph_rows(derive.corpus(spark, d)), _paragraph_rows(_old_corpus(spark, d)))
    )


def _stamped(rows, at):
    return rows.withColumn("created_at", F.to_timestamp(F.lit(at))).withColumn("updated_at", F.to_timestamp(F.lit(at)))


@query(
    "U4_upsert",
    ctes("""SELECT doc_id, chunk_index, sha256(coalesce(new_content, old_content)) AS content_hash,
              CASE WHEN old_content IS NULL THEN 1710892800 ELSE 1704067200 END::BIGINT AS created_at,
              CASE WHEN new_content IS NULL THEN 1704067200 ELSE 1710892800 END::BIGINT AS updated_at FROM chunk_states"""),
)
def upsert(spark, d):
    old = _stamped(_paragraph_rows(_old_corpus(spark, d)), "2024-01-01 00:00:00")
    new = _stamped(_paragraph_rows(derive.corpus(spark, d)), derive.AS_OF)
    merged = load.upsert(old, new, ["doc_id", "chunk_index"], ["content", "content_hash", "updated_at"])
    return flat(merged.drop("content"))


@query(
    "U5_prune_chunks",
    ctes("SELECT doc_id, chunk_index, sha256(old_content) AS content_hash FROM chunk_states WHERE old_content IS NOT NULL AND status <> 'removed'"),
)
def prune_chunks(spark, d):
    old, new = _paragraph_rows(_old_corpus(spark, d)), _paragraph_rows(derive.corpus(spark, d))
    return flat(load.prune_chunks(old, new).select("doc_id", "chunk_index", "content_hash"))


@query(
    "U6_insert_ignore",
    ctes("SELECT upload_id, user_id, part_index, data FROM parts QUALIFY row_number() OVER (PARTITION BY upload_id, user_id, part_index ORDER BY created_at) = 1"),
)
def insert_ignore(spark, d):
    """Parts of the first ten days are stored already; all parts arrive again."""
    parts = derive.upload_parts(spark, d)
    stored = parts.filter("created_at < TIMESTAMP '2024-01-11'")
    key = ["upload_id", "user_id", "part_index"]
    once = load.insert_ignore(stored.filter("false"), stored, key, ["created_at"])
    merged = load.insert_ignore(once, parts, key, ["created_at"])
    return flat(merged.select(*key, F.col("data").cast("string").alias("data")))


@query(
    "U7_upsert_coalesce",
    ctes("""SELECT user_id, doc_id, f.id, coalesce(s.note, f.note) AS note FROM favorites f
            JOIN (SELECT user_id, doc_id, max_by(note, id) AS note FROM (SELECT user_id, doc_id, id, CASE WHEN id % 2 = 0 THEN 'again ' || id END AS note FROM saves) GROUP BY 1, 2) s USING (user_id, doc_id)"""),
)
def upsert_coalesce(spark, d):
    saved = derive.favorites(spark, d)
    note = F.when(F.col("id") % 2 == 0, F.concat(F.lit("again "), F.col("id").cast("string")))
    last = (
        derive.saves(spark, d).groupBy("user_id", "doc_id")
        .agg(F.max_by(F.struct(note.alias("note")), "id").alias("n")).select("user_id", "doc_id", "n.note")
        .join(saved.select("user_id", "doc_id"), ["user_id", "doc_id"], "left_semi")
    )
    merged = load.upsert(saved, last, ["user_id", "doc_id"], [], coalesce_cols=["note"])
    return merged.select("user_id", "doc_id", "id", "note")


CTES["changed_bodies"] = "SELECT n.* FROM bodies n LEFT JOIN old_bodies o USING (doc_id) WHERE o.doc_id IS NULL OR o.body <> n.body"


@query(
    "U2_U4_U5_load_in_place",
    ctes(
        sql_chunks("bodies", "doc_no")
        + "SELECT b.doc_id, p.chunk_index, sha256(p.content) AS content_hash FROM packed p JOIN bodies b USING (doc_no)"
    ),
)
def load_in_place(spark, d):
    """The earlier load is stored; the new one appends only the rows it changes."""
    path = fresh_dir(spark, "store")
    columns = ["doc_id", "url", "title", "markdown", "doc_type", "language"]
    nothing = spark.createDataFrame([], "doc_id string, chunk_index int, content_hash string, source_hash string")
    now = derive.as_of()
    # Written once: the first load reads its texts for the chunks and for the documents.
    earlier = written(_old_corpus(spark, d).select(*columns))
    first = ingest.plan_load(earlier, nothing, nothing, now)
    tables.write_chunks(first.changed_chunks, path, buckets=32)
    first.documents.select("doc_id", "source_hash").write.parquet(f"{path}-documents")
    second = ingest.plan_load(
        derive.corpus(spark, d).select(*columns),
        spark.read.parquet(f"{path}-documents"),
        tables.read_chunks(spark, path),
        now,
    )
    tables.merge_chunks(spark, path, second.changed_chunks, second.loaded, buckets=32)
    return flat(tables.read_chunks(spark, path, columns=["doc_id", "chunk_index", "content_hash"]))


@query(
    "U4_merge_keeps_scope",
    ctes("""
  SELECT doc_id, 0::BIGINT AS chunk_index,
         CASE WHEN doc_no % 3 = 1 THEN sha256('new ' || url) ELSE sha256(url) END AS content_hash,
         CASE WHEN doc_no % 2 = 0 THEN 's' || (doc_no % 7) END AS session_id
  FROM corpus
  UNION ALL
  SELECT 'added-' || doc_id, 0::BIGINT, sha256('new ' || url), NULL FROM corpus WHERE doc_no % 5 = 0"""),
)
def merge_keeps_scope(spark, d):
    """Uploads and public documents share buckets; a load without owners leaves every owner as it was."""
    path = fresh_dir(spark, "scoped")
    docs = derive.corpus(spark, d)
    session = F.when(F.col("doc_no") % 2 == 0, F.concat(F.lit("s"), (F.col("doc_no") % 7).cast("string")))
    rows = docs.select(
        "doc_id", F.lit(0).alias("chunk_index"), F.sha2("url", 256).alias("content_hash"), session.alias("session_id")
    )
    tables.write_chunks(rows, path, buckets=16)
    fresh = F.sha2(F.concat(F.lit("new "), F.col("url")), 256).alias("content_hash")
    changed = docs.filter("doc_no % 3 = 1").select("doc_id", F.lit(0).alias("chunk_index"), fresh)
    added = docs.filter("doc_no % 5 = 0").select(F.concat(F.lit("added-"), "doc_id").alias("doc_id"), F.lit(0).alias("chunk_index"), fresh)
    new = changed.unionByName(added)
    tables.merge_chunks(spark, path, new, new.select("doc_id", "chunk_index"), buckets=16)
    return flat(tables.read_chunks(spark, path).select("doc_id", "chunk_index", "content_hash", "session_id"))
