"""All queries of the library's operators with their SQL statements."""

from __future__ import annotations

from trendloom.plans import graph_queries, intake_queries, keyword_queries, report_queries, user_queries

_MODULES = (intake_queries, keyword_queries, graph_queries, user_queries, report_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
