"""The queries outside the training-data operators, by name, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, table reader) by its name, with the SQL of its result."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: table(spark, sf_dir, name))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def streamed(sql: str | None = None):
    """Registers a function of (spark, sf_dir), which reads its tables as streams."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
