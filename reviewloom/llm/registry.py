"""Where the operators' queries are registered, apart from the review queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from reviewloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that must give the same rows where there is one."""

    def add(fn: Query) -> Query:
        @wraps(fn)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ship_package(spark), sf_dir)

        QUERIES[fn.__name__] = shipped
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add
