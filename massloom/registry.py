"""Registry that keeps each query next to its SQL twin."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from massloom.plans.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed(sql: str) -> list[str]:
    """Views a statement mentions, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(body)
                order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    """One statement: the derived views as CTEs, then the query's own."""
    sql = sql.strip()
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in _needed(sql))
    if not ctes:
        return sql
    if sql[:5].upper() == "WITH ":
        return f"WITH {ctes}, {sql[5:]}"
    return f"WITH {ctes} {sql}"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
