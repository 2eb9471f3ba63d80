"""The registry of queries: a function of a Journal by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.journal import VIEWS, Journal

_queries: dict[str, Callable[[Journal], DataFrame]] = {}
_sql: dict[str, str] = {}

SINCE, UNTIL = "1997-01-01", "1998-12-31"
NOTE = 7
QUESTION = "the thing that was with her"


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " if sql.lstrip().startswith(",") else " ") + sql.lstrip().lstrip(",")


def avg(x: str) -> str:
    n = f"count({x})"
    return f"CASE WHEN {n} > 0 THEN CAST((2 * sum(CAST(round({x} * 100) AS BIGINT)) + {n}) // (2 * {n}) AS DOUBLE) / 100.0 END"


def query(name: str, sql: str | None = None, *views: str):
    """Registers a function of a Journal; `sql` reads the named views and the driver's tables."""

    def register(f):
        _queries[name] = f
        if sql is not None:
            _sql[name] = with_views(sql, *views) if views else sql
        return f

    return register


def queries():
    return {name: (lambda spark, folder, f=f: f(Journal(spark, folder))) for name, f in _queries.items()}


def oracle_sql():
    return dict(_sql)
