"""Search served from stored cells and postings: a question opens the partitions it needs, not the corpus.

Both tables are stored as loads (``sources/appended.py``) and change only with changed chunks:

* ``path/cells``: chunk vectors with the facts filters and ownership ask for, partitioned by the nearest trained centre
  (``path/centres``, a small table). A question reads the cells of its ``probes`` nearest centres.
* ``path/postings``: term, chunk, positions, partitioned by a hash of the term. A question reads its terms' partitions;
  chunks come from its rarest term's list, the other lists are only asked about those.
* ``path/terms``: document frequencies, partitioned alike.

What a batch of questions opens is a partition filter of numbers known before the scan, at most one for each cell or part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators import filters as flt
from corpusflow.operators import fusion, lexical, vector
from corpusflow.operators.filters import PairRules
from corpusflow.operators.ordered import largest, top_per_group
from corpusflow.session import fits_broadcast, join_checked, settled
from corpusflow.sources import appended

PARTS = 64
CELL_KEY = ["cell", "chunk_id"]
POSTING_KEY = ["term", "chunk_id"]
FACTS = ("metadata", "session_id", "owner")


def part_of(term: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _numbers(column: DataFrame) -> list[int]:
    """Distinct partition numbers: as many as there are partitions at most."""
    return sorted(row[0] for row in column.distinct().collect())


# ---- cells -----------------------------------------------------------------


def mean_centres(items: DataFrame, label: str) -> vector.Cells:
    """One centre per label: the plain mean of its vectors. As many rows as labels reach the driver."""
    rows = items.filter(F.col("embedding").isNotNull()).select(F.col(label).cast("string").alias("label"), F.col("embedding").alias("vector"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, list] = {}
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            values = flat.reshape(batch.num_rows, -1)
            coded = batch.column("label").dictionary_encode("encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(coded.dictionary.to_pylist()):
                mine = values[codes == code]
                held = total.setdefault(name, [0, 0.0])
                total[name] = [held[0] + len(mine), held[1] + mine.sum(axis=0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([n for n, _ in total.values()], pa.int64()),
             pa.array([list(v) for _, v in total.values()], pa.list_(pa.float64()))],
            names=["label", "n", "sums"],
        )

    # A task hands on one row per label, so no element of a vector is a row of its own before that.
    parts = rows.mapInArrow(sums, "label string, n bigint, sums array<double>")
    placed = parts.select("label", "n", F.posexplode("sums").alias("dim", "value"))
    means = placed.groupBy("label", "dim").agg((F.sum("value") / F.sum("n")).alias("value"))
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("centre"))
    return vector.Cells(np.array([r["centre"] for r in rows.orderBy("label").collect()]))


def _cell_rows(chunks: DataFrame, cells: vector.Cells) -> DataFrame:
    facts = [c for c in FACTS if c in chunks.columns]
    kept = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding", *facts)
    return cells.nearest(kept, "embedding", 1).withColumn("bucket", F.col("cell"))


def build_cells(chunks: DataFrame, path: str, cells: vector.Cells) -> None:
    """Stores every chunk in its cell, and the centres."""
    spark = chunks.sparkSession
    centres = [(i, [float(x) for x in row]) for i, row in enumerate(cells.centres)]
    spark.createDataFrame(centres, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    appended.write(_cell_rows(chunks, cells), f"{path}/cells", base=True)


def read_centres(spark: SparkSession, path: str) -> vector.Cells:
    rows = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").collect()
    return vector.Cells(np.array([r["centre"] for r in rows]))


def update_cells(old: DataFrame, new: DataFrame, path: str) -> None:
    """Appends what changed: ``old`` and ``new`` are the changed chunks before and after a load."""
    cells = read_centres(new.sparkSession, path)
    changed = settled(appended.changes(_cell_rows(old, cells), _cell_rows(new, cells), CELL_KEY))
    if not changed.isEmpty():
        appended.write(changed, f"{path}/cells")


def knn_stored(
    spark: SparkSession, path: str, queries: DataFrame, k: int | str, *, probes: int, filters: bool = False, scope: bool = False
) -> DataFrame:
    """k nearest chunks of every query in its ``probes`` nearest cells: query_id, item_id, similarity, rank.

    While the queries are few they go to every task, and each batch of a cell meets the queries that probe the cell; no vector is
    shuffled. Beyond that both sides meet in blocks.
    """
    rules = PairRules(filters, scope)
    asked = queries.filter(F.col("embedding").isNotNull())
    q, _ = vector._prepare(asked, asked.withColumns({"item_id": F.lit(0), **{c: F.lit(None) for c in FACTS}}), k, rules)
    q = settled(read_centres(spark, path).nearest(q, "query_vector", probes))
    wanted = _numbers(q.select("cell"))
    stored = appended.read(spark, f"{path}/cells", CELL_KEY, buckets=wanted)
    items = stored.select(F.col("chunk_id").alias("item_id"), F.col("embedding").alias("item_vector"), *rules.item_columns, "cell")
    if not fits_broadcast(q, limit=vector.QUERY_BLOCK_ROWS):
        return vector._rank(vector._grid(q, items, k, rules, few_cells=True), q.drop("cell").dropDuplicates(["query_id"]), k)
    table = q.drop("cell").dropDuplicates(["query_id"]).orderBy("query_id").toArrow()
    place = {v: i for i, v in enumerate(table.column("query_id").to_pylist())}
    probing: dict[int, list[int]] = {}
    for row in q.select("query_id", "cell").collect():  # QUERY_BLOCK_ROWS pairs at most
        probing.setdefault(row["cell"], []).append(place[row["query_id"]])
    shared = spark.sparkContext.broadcast((vars(vector._block(table, rules, k)), probing))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, by_cell = shared.value
        whole = vector.QueryBlock(**fields)
        best: dict[int, vector._Best] = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells):
                if cell not in best:
                    rows = np.array(sorted(by_cell[cell]), dtype=np.int64)
                    best[cell] = vector._Best(vector.QueryBlock(whole.ids[rows], whole.unit[rows], whole.k[rows], whole.rules, whole.rule_of[rows]))
                best[cell].add(batch.filter(pa.array(cells == cell)), rules)
        for found in best.values():
            yield pa.RecordBatch.from_arrays(found.arrays(), names=vector.NAMES)

    return vector._rank(items.mapInArrow(scan, vector.SCHEMA), q.drop("cell").dropDuplicates(["query_id"]), k)


# ---- postings --------------------------------------------------------------


def _posting_rows(chunks: DataFrame, parts: int) -> DataFrame:
    return lexical.build_postings(chunks).withColumn("bucket", part_of(F.col("term"), parts))


def build_postings_store(chunks: DataFrame, path: str, parts: int = PARTS) -> None:
    rows = _posting_rows(chunks, parts)
    appended.write(rows, f"{path}/postings", base=True)
    stats = lexical.term_stats(appended.read(chunks.sparkSession, f"{path}/postings", POSTING_KEY))
    appended.write(stats.withColumn("bucket", part_of(F.col("term"), parts)), f"{path}/terms", base=True)


def update_postings(old: DataFrame, new: DataFrame, path: str, parts: int = PARTS) -> None:
    """Appends the postings that changed chunks gain, change and lose, and the frequencies that move with them."""
    spark = new.sparkSession
    words = [df.select("chunk_id", F.sha2(F.array_join("tokens", " "), 256).alias("words")) for df in (old, new)]
    if appended.changes(*words, ["chunk_id"]).isEmpty():
        return
    changed = lexical.changed_postings(old, new, appended.GONE).withColumn("bucket", part_of(F.col("term"), parts))
    before = old.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term"), F.lit(-1).alias("d"))
    after = new.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term"), F.lit(1).alias("d"))
    moved = before.unionByName(after).groupBy("term").agg(F.sum("d").alias("d")).filter("d <> 0")
    moved = settled(moved.withColumn("bucket", part_of(F.col("term"), parts)))
    stored = appended.read(spark, f"{path}/terms", ["term"], buckets=_numbers(moved.select("bucket")))
    now = moved.join(stored, "term", "left").select("term", (F.coalesce("df", F.lit(0)) + F.col("d")).alias("df"), "bucket")
    appended.write(now.withColumn(appended.GONE, F.col("df") <= 0), f"{path}/terms")
    appended.write(changed, f"{path}/postings")


def lexical_stored(
    spark: SparkSession, path: str, queries: DataFrame, k: int | str, *, chunks: DataFrame | None = None,
    filters: bool = False, scope: bool = False, parts: int = PARTS,
) -> DataFrame:
    """Best ``k`` matching chunks per query from the stored lists: query_id, chunk_id, lexical, rank.

    ``chunks`` (chunk_id and the facts asked for) is only needed with ``filters`` or ``scope``.
    """
    fits = lexical._fits(queries)
    asks, members = lexical.distinct_asks(queries, lexical._extra(filters, scope))
    asks = settled(asks)
    needed = settled(asks.select(F.explode("terms").alias("term")).distinct().withColumn("part", part_of(F.col("term"), parts)))
    buckets = _numbers(needed.select("part"))
    stats = join_checked(appended.read(spark, f"{path}/terms", ["term"], buckets=buckets), needed.select("term"), "term", "left_semi", small_fits=fits)
    each = asks.select("ask_id", F.posexplode("terms").alias("nth", "term")).join(stats, "term")
    rarest = each.groupBy("ask_id").agg(F.min(F.struct("df", "term")).alias("rare"), F.count(F.lit(1)).alias("known"))
    # An ask with a term that no chunk has finds nothing.
    asked = settled(asks.join(rarest, "ask_id").filter(F.col("known") == F.size("terms")).select(*asks.columns, F.col("rare.term").alias("rare")))
    def lists(within: DataFrame, fits: bool) -> DataFrame:
        rows = appended.read(spark, f"{path}/postings", POSTING_KEY, buckets=buckets, within=within, within_fits=fits)
        return rows.select("term", "chunk_id", "positions")

    first = asked.select("ask_id", F.col("rare").alias("term"))
    met = join_checked(lists(first.select("term").distinct(), fits), first, "term", small_fits=fits)
    # Numbers only: this is read three times.
    met = settled(met.select("ask_id", "chunk_id", F.size("positions").alias("tf")))
    found = join_checked(met, asked.select("ask_id", "terms"), "ask_id", small_fits=fits)
    one = found.filter(F.size("terms") == 1).select("ask_id", "chunk_id", F.round(F.lit(lexical.COVER_WEIGHT) * F.col("tf"), lexical.DIGITS).alias("lexical"))
    # Only chunks of the rarest list ask the other lists; (term, chunk) spreads even the most frequent term.
    several = found.filter(F.size("terms") > 1).select("ask_id", "chunk_id", "terms", F.posexplode("terms").alias("nth", "term"))
    pairs = several.select(*POSTING_KEY).distinct()
    few = fits_broadcast(pairs)
    others = lists(pairs, True) if few else lists(needed.select("term"), fits)
    place = F.transform("positions", lambda p: F.struct(p.alias("pos"), (F.col("nth") + 1).alias("term")))
    hits = (
        several.join(others, POSTING_KEY).select("ask_id", "chunk_id", "terms", place.alias("hits"))
        .groupBy("ask_id", "chunk_id").agg(F.first("terms").alias("terms"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == F.size("terms"))
    )
    scored = one.unionByName(hits.select("ask_id", "chunk_id", lexical.cover_of_hits(F.col("terms"), F.col("hits")).alias("lexical")))
    if filters or scope:
        facts = chunks.select("chunk_id", *[c for c in FACTS if c in chunks.columns])
        wanted = asked.select("ask_id", *lexical._extra(filters, scope))
        scored = scored.join(facts, "chunk_id").join(wanted, "ask_id")
        if filters:
            scored = scored.filter(flt.matches(F.col("filters"), F.col("metadata")))
        if scope:
            scored = scored.filter(flt.visible(F.col("user_id"), F.col("session_id"), F.col("owner")))
        scored = scored.select("ask_id", "chunk_id", "lexical")
    order = [F.col("lexical").desc(), F.col("chunk_id")]
    best = top_per_group(scored, ["ask_id"], order, k if isinstance(k, int) else largest(queries, k))
    if isinstance(k, str):
        members = members.join(queries.select("query_id", F.col(k).alias("__k")), "query_id")
    out = join_checked(best, members, "ask_id", small_fits=fits)
    if isinstance(k, str):
        out = out.filter(F.col("rank") <= F.col("__k"))
    return out.select("query_id", "chunk_id", "lexical", "rank")


def hybrid_stored(
    spark: SparkSession, path: str, queries: DataFrame, candidate_k: int | str = fusion.CANDIDATE_K, *, probes: int, rrf_k: int = fusion.RRF_K,
    chunks: DataFrame | None = None, filters: bool = False, scope: bool = False, parts: int = PARTS, modes: bool = False,
) -> DataFrame:
    """Both stored searches fused, best ``candidate_k`` per query; with ``modes`` each query's ``mode`` chooses its side."""
    asked = fusion._worded(queries)
    by_vector, by_words = (asked.filter(F.col("mode") != other) if modes else asked for other in ("lexical", "vector"))
    near = knn_stored(spark, path, by_vector, candidate_k, probes=probes, filters=filters, scope=scope)
    worded = lexical_stored(spark, path, by_words, candidate_k, chunks=chunks, filters=filters, scope=scope, parts=parts)
    return fusion.choose(near, worded, asked, candidate_k, rrf_k, modes=modes)
