"""Name of a query to its function, and to the SQL statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlake.plans import catalog_queries, event_queries, facet_queries, join_queries, text_queries

_PARTS = (facet_queries, join_queries, text_queries, event_queries, catalog_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: sql for part in _PARTS for k, sql in part.ORACLE_SQL.items()}
