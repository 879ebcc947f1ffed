"""All queries of the core engine with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, match_queries, overlay_queries, package_queries, page_queries, run_queries, text_queries, timeline_queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _part in (text_queries, match_queries, timeline_queries, audit_queries, package_queries, page_queries, overlay_queries, run_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
