"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.plans import brief_queries, content_queries, function_queries, model_queries, page_queries, place_queries, planted_queries, report_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**page_queries.QUERIES, **content_queries.QUERIES, **place_queries.QUERIES, **table_queries.QUERIES, **function_queries.QUERIES, **report_queries.QUERIES, **brief_queries.QUERIES, **model_queries.QUERIES, **planted_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**page_queries.ORACLE_SQL, **content_queries.ORACLE_SQL, **place_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **function_queries.ORACLE_SQL, **report_queries.ORACLE_SQL, **brief_queries.ORACLE_SQL, **model_queries.ORACLE_SQL, **planted_queries.ORACLE_SQL}
