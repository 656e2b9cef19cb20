"""Registry of the engine's queries and their DuckDB equivalents."""

from __future__ import annotations

from dockmill.plans import analytics, decisions, fields, further, profiles, retrieval, rows, search, walks

QUERIES = analytics.QUERIES | rows.QUERIES | retrieval.QUERIES | further.QUERIES | decisions.QUERIES | fields.QUERIES | profiles.QUERIES | search.QUERIES | walks.QUERIES
ORACLE_SQL = analytics.ORACLE_SQL | rows.ORACLE_SQL | retrieval.ORACLE_SQL | further.ORACLE_SQL | decisions.ORACLE_SQL | fields.ORACLE_SQL | profiles.ORACLE_SQL | search.ORACLE_SQL | walks.ORACLE_SQL
