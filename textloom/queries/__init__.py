"""Catalogue of queries over the driver's tables."""

from textloom.queries import budgets, evals, logs, packs, sources, streams, texts, tokens  # noqa: F401
from textloom.queries.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
