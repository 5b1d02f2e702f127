"""All queries of the core, and their SQL."""

from __future__ import annotations

from scansio.plans import core_queries, matching_queries, nested_queries

MODULES = [core_queries, matching_queries, nested_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
