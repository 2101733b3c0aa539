"""Query registry: Spark callables and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ctes import CTES
from .views import TABLES, VIEWS


class Tables:
    """The test tables of one scale folder, and the case tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self._view(name)
        if name in TABLES:
            return self.spark.read.parquet(self.path(name))
        raise AttributeError(name)

    def _view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        used = {t: getattr(self, t) for t in TABLES if f"{{{t}}}" in sql}
        return self.spark.sql(sql, **used)


_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use any name in ``CTES`` as a table."""

    def register(function: Callable[[Tables], DataFrame]):
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = _with_ctes(sql)
        return function

    return register


def _with_ctes(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in CTES and word not in needed:
                visit(CTES[word])
                if word not in needed:
                    needed.append(word)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS (\n{CTES[name].strip()}\n)" for name in needed)
    # A query that starts with a comma continues the list with tables of its own.
    return f"WITH {ctes}\n{sql.strip()}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function):
        return lambda spark, folder: function(Tables(spark, folder))

    return {name: bind(function) for name, function in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
