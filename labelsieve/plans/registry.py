"""Registry of the queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function name; ``sql`` gives the same rows on plain SQL, after the views."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            prefix = f"WITH {', '.join(views)}\n" if views else ""
            ORACLES[function.__name__] = prefix + sql.strip()
        return function

    return register


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)
