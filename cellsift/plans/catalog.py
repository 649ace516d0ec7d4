"""Registry of queries over the driver's tables and the SQL that states each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL if any."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(col: str | Column, digits: int = 6, name: str | None = None) -> Column:
    column = F.col(col) if isinstance(col, str) else col
    return F.round(column, digits).alias(name or col)


def load_all() -> None:
    """Import every module that registers queries."""
    from cellsift.plans import (  # noqa: F401
        queries_aggregates,
        queries_learning,
        queries_relational,
        queries_samplers,
        queries_sources,
    )
