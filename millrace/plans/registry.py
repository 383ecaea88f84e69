"""Registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.views import DOCS_SQL, FLOWS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_VIEWS = {"flows": FLOWS_SQL, "docs": DOCS_SQL}


def query(sql: str | None = None, views: str = "flows") -> Callable[[Query], Query]:
    """Registers a function under its name; sql follows WITH and the named views, which it may extend after a comma."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            heads = ", ".join(_VIEWS[v] for v in views.split())
            ORACLE_SQL[fn.__name__] = (f"WITH {heads}{'' if sql.lstrip().startswith(',') else ' '}{sql.strip()}" if heads else sql.strip())
        return fn

    return register
