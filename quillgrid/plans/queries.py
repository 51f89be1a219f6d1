"""Registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from quillgrid.plans import catalogue_queries, sheet_queries, text_queries

_PARTS = (sheet_queries, catalogue_queries, text_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL = {k: s for part in _PARTS for k, s in part.SQL.items()}
