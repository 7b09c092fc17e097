"""Importing this module registers the queries of the subpackage."""

from corpusflow.llm import queries_decontaminate, queries_mixing, queries_near_dedup, queries_repeats, queries_secrets, queries_tokens, queries_toxicity, queries_trie, queries_url, queries_variants, queries_warc, queries_winnow  # noqa: F401
from corpusflow.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
