"""All queries of the library by the ID of their operator, and their SQL where there is one."""

from __future__ import annotations

from . import feature_queries, label_queries, space_queries, table_queries, track_queries

_PARTS = (feature_queries, track_queries, label_queries, space_queries, table_queries)
QUERIES = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLE = {k: q for part in _PARTS for k, q in part.ORACLE.items()}
