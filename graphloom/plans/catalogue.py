"""All registered queries of the engine, with their DuckDB counterparts."""

from __future__ import annotations

from . import audit_queries, findings_queries, fulltext_queries, graph_queries, hunt_queries, limiter_queries, lookup_queries, reply_queries, report_queries, retrieval_queries, text_queries, wiring_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
