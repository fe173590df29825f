"""Registry of the base library's queries: QUERIES by name, and ORACLE_SQL with DuckDB's twin of each."""

from __future__ import annotations

from .plans import cases, enrich, files, links, messages, models, scoring, texts, verdicts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _plans in (cases, links, texts, scoring, verdicts, files, enrich, messages, models):
    QUERIES |= _plans.QUERIES
    ORACLE_SQL |= _plans.ORACLE_SQL
