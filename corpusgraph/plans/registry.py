"""The registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from . import concept_queries, document_queries, gap_queries, graph_queries, history_queries, summary_queries, view_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (concept_queries, document_queries, gap_queries, graph_queries, history_queries, summary_queries, view_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
