"""All queries of the library by name, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentloom.plans import answer_queries, ingest_queries, parse_queries, record_queries, resume_queries, search_queries, table_queries, term_queries

FLAGSHIP = "criteria_search"
_MODULES = (search_queries, term_queries, table_queries, ingest_queries, parse_queries, record_queries, resume_queries, answer_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
