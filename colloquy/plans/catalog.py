"""Every query of the library's own operators, by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.plans import account_queries, analysis_queries, briefing_queries, ingest_queries, record_queries, source_queries, text_queries, turn_queries, validation_queries

__all__ = ["oracle_sql", "queries"]

_MODULES = (text_queries, turn_queries, analysis_queries, briefing_queries, account_queries, validation_queries, ingest_queries, record_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
