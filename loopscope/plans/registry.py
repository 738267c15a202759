"""Queries by name, with the SQL that an independent engine answers them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    """Doubles are compared to six places: sums in another order differ beyond."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def n(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)
