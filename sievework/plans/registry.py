"""The registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 9)
    return out.alias(name or c) if name or isinstance(c, str) else out
