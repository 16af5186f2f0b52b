"""All registered queries of the library, by name, and their SQL."""

from __future__ import annotations

from .plans import form_queries, graph_queries, plan_queries, set_queries, table_queries, walk_queries

_REGISTRIES = [form_queries.R, graph_queries.R, plan_queries.R, set_queries.R, table_queries.R, walk_queries.R]

QUERIES = {name: f for r in _REGISTRIES for name, f in r.queries.items()}
ORACLE_SQL = {name: sql for r in _REGISTRIES for name, sql in r.sql.items()}
