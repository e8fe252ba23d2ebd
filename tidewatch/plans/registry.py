"""All registered queries and their SQL."""

from __future__ import annotations

from . import extraction_queries, history_queries, radar_queries, switch_queries, trade_queries

_MODULES = (radar_queries, trade_queries, extraction_queries, switch_queries, history_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
