"""Times the headline jobs and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derive
from checks.catalog import QUERIES
from corpusflow.operators import fusion, lexical, vector
from corpusflow.session import get_spark
from corpusflow.streaming.run import fresh_dir

# Registered queries, timed from the given tables to the full result.
JOBS = [
    "P11_P12_P13_chunk_text",
    "P14_chunk_documents",
    "P19_price",
    "P25_embed_documents",
    "U2_diff_chunks",
    "U4_upsert",
    "U2_U4_U5_load_in_place",
    "R6_knn_exact",
    "R7_knn_cells",
    "L1_postings",
    "L4_lexical_search",
    "L4_short_queries",
    "R10_hybrid_search",
    "R14_shape_sources",
    "R20_stride_sample",
    "R21_doc_chunks",
    "S2_list_sessions",
    "S8_alternate_turns",
    "M3_build_memory",
    "M4_recall",
    "F1_user_context",
    "V1_list_favorites",
    "D5_assemble_uploads",
    "A1_top_cited",
    "A5_usage_cost",
    "A10_over_limit",
    "E1_retrieval_recall",
    "E5_eval_summary",
    "T1_assemble_turns_stream",
    "T5_over_limit_stream",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(name: str, out: dict[str, float], job) -> None:
    start = time.time()
    job()
    out[name] = round(time.time() - start, 3)
    print(f"{name:28s} {out[name]:8.3f}s", file=sys.stderr, flush=True)


def stored_index(spark: SparkSession, d: str, out: dict[str, float]) -> dict[str, float]:
    """Search the way a service would: the index is written once, then asked."""
    path = fresh_dir(spark, "index")
    columns = ["chunk_id", "doc_id", "url", "chunk_index", "content", "session_id", "metadata", "tokens", "embedding"]

    def build() -> None:
        derive.search_chunks(spark, d).select(*columns).write.parquet(f"{path}/chunks")
        terms = spark.read.parquet(f"{path}/chunks").select(F.explode(F.array_distinct("tokens")).alias("term"))
        terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/terms")

    timed("index_build", out, build)
    chunks = spark.read.parquet(f"{path}/chunks")
    stats = spark.read.parquet(f"{path}/terms")
    derive.asked(spark, d).write.parquet(f"{path}/queries")
    queries = spark.read.parquet(f"{path}/queries")
    n = queries.count()
    items = chunks.withColumnRenamed("chunk_id", "item_id")
    timed("index_knn_exact", out, lambda: run(vector.knn(queries, items, 32)))
    timed("index_lexical", out, lambda: run(lexical.lexical_search(queries, chunks, 32, stats=stats)))
    timed(
        "index_hybrid", out,
        lambda: run(fusion.hybrid_search(queries, chunks, stats=stats, columns=["doc_id", "content"])),
    )
    return {
        f"{name}_per_second": round(n / out[f"index_{name}"], 1) for name in ("knn_exact", "lexical", "hybrid")
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    times: dict[str, float] = {}
    run(derive.corpus(spark, folder))  # start the workers before timing
    for name in JOBS:
        if not wanted or any(name.startswith(w) for w in wanted):
            timed(name, times, lambda: run(QUERIES[name](spark, folder)))
    rates = stored_index(spark, folder, times) if not wanted or "index" in wanted else {}
    print(
        json.dumps(
            {
                "metric": "headline jobs, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
