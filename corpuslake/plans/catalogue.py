"""Every query of the library by name, with the SQL that it is held against."""

from __future__ import annotations

from corpuslake.plans import dashboard_queries, source_queries, text_queries, web_queries

_ENTRIES = {**text_queries.ENTRIES, **dashboard_queries.ENTRIES, **web_queries.ENTRIES, **source_queries.ENTRIES}

QUERIES = {name: f for name, (f, _) in _ENTRIES.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ENTRIES.items() if sql is not None}
