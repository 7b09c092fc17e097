"""Importing a module registers its queries."""

from checks import conversations, loading, measures, people, preparation, retrieval, streams  # noqa: F401
from checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
