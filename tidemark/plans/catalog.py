"""Registered queries of the analytics operators and their SQL."""

from __future__ import annotations

from tidemark.plans import source_queries, text_queries, trace_queries, vector_queries  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
