"""JSON documents kept as VARIANT columns: typed paths, and nulls told apart from what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_variant(text: Column) -> Column:
    """The document as a VARIANT; null for a text that is no JSON."""
    return F.try_parse_json(text)


def field_state(document: Column, path: str) -> Column:
    """``value``, ``null`` for a JSON null, ``missing`` for no such field, ``no document`` for none at all."""
    found = F.try_variant_get(document, path, "variant")
    return (
        F.when(document.isNull(), "no document")
        .when(found.isNull(), "missing")
        .when(F.is_variant_null(found), "null")
        .otherwise("value")
    )


def field(document: Column, path: str, kind: str) -> Column:
    """The field as ``kind``; null where it is missing, a JSON null, or no such value."""
    return F.try_variant_get(document, path, kind)


def with_parameter(runs: DataFrame, path: str, kind: str, wanted, column: str = "parameters") -> DataFrame:
    """The runs whose parameter at ``path`` equals ``wanted``; a run without it is left out."""
    return runs.filter(F.coalesce(field(F.col(column), path, kind) == F.lit(wanted), F.lit(False)))
