"""Queries of this package's operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from ledgerloom.llm import name_queries, product_queries, representative_queries, token_queries, venue_queries

_ALL = (name_queries, venue_queries, representative_queries, product_queries, token_queries)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
SQL = {k: s for m in _ALL for k, s in m.SQL.items()}
