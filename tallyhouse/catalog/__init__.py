"""Registered queries over the test tables, each with the SQL that checks it."""

from . import case_queries, column_queries, statistics_queries  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
