"""Registered queries against their SQL twins on the small tables.

All of them with CORPUSFLOW_ALL=1; otherwise one or two per part, because the
same comparison runs for every query outside this suite.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, database

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "I2_pages_to_corpus", "P4_url_parts", "P11_P12_P13_chunk_text", "P22_types", "U2_diff_chunks", "U4_upsert",
    "R4_filtered_pairs", "R6_knn_scoped", "R10_hybrid_search", "R14_shape_sources", "R21_doc_chunks", "L4_lexical_search",
    "S2_list_sessions", "S9_delete_sessions", "M3_build_memory", "M4_recall", "F1_user_context", "V3_add_again",
    "D5_assemble_uploads", "A5_usage_cost", "A7_classify_errors", "E2_citation_validity", "E6_eval_breakdown",
    "T1_assemble_turns", "T5_over_limit_stream",
]
NAMES = list(entry.queries()) if os.environ.get("CORPUSFLOW_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    problem, *_ = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert not problem


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_listings_of_one_file_are_read_by_all_cores(spark):
    from checks import derive

    rows = derive.listings(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_retrieve_encodes_rewritten_questions(spark, con):
    """The rules that rewrite a question must not end up inside a filter above the encoder."""
    problem, *_ = compare(spark, con, FOLDER, "R10_R14_retrieve", entry.queries()["R10_R14_retrieve"], entry.oracle_sql()["R10_R14_retrieve"])
    assert not problem
