"""Queries by name, and the SQL that DuckDB runs for the same results."""

from __future__ import annotations

from factloom.queries import entities, relational, stores, texts

FLAGSHIP = "guarded_revenue_by_nation"
_MODULES = (relational, texts, entities, stores)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
