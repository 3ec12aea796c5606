"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that later filters read instead of computing it again.

    Filters are pushed below a plain projection and repeat its expressions;
    they stay above a generator.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))
