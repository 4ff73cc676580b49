"""The queries of the library's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_plans, queries_rules, queries_text

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "exact_cache_lookup"
_EVERY = queries_text.QUERIES | queries_plans.QUERIES | queries_rules.QUERIES
_EVERY |= {name: (_EVERY[name][0], sql) for name, sql in queries_rules.SQL_FOR.items()}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _EVERY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _EVERY.items() if sql}
