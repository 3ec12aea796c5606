"""Branch lists: JSON arrays of ``{name, url}`` objects or bare links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.text import or_default


def read_branch_list(spark: SparkSession, path: str) -> DataFrame:
    """Branches ``(name, url)`` of the JSON files below ``path``; a missing path is an error."""
    return branches_of(spark.read.option("wholetext", True).text(path), F.col("value")).select("name", "url")


def branches_of(lists: DataFrame, document: Column) -> DataFrame:
    """One row per usable item of each JSON array, next to the columns of ``lists``.

    Objects need a non-empty ``url`` and fall back to it for the name; a bare
    string is both; any other item is dropped.
    """
    items = lists.withColumn("items", F.try_variant_get(F.parse_json(document), "$", "array<variant>"))
    item = F.col("item")
    kind = F.schema_of_variant(item)
    text = F.when(kind == "STRING", F.try_variant_get(item, "$", "string"))
    is_object = F.startswith(kind, F.lit("OBJECT"))
    url = F.when(is_object, F.nullif(F.try_variant_get(item, "$.url", "string"), F.lit("")))
    name = F.try_variant_get(item, "$.name", "string")
    return (
        items.select(*lists.columns, F.explode_outer("items").alias("item"))
        .select(
            *lists.columns,
            F.coalesce(text, F.when(is_object, or_default(name, url))).alias("name"),
            F.coalesce(text, url).alias("url"),
        )
        .filter(F.col("url").isNotNull())
    )


def write_branch_list(branches: DataFrame, path: str) -> None:
    """One JSON object per line; :func:`read_branch_lines` reads it back in parallel."""
    branches.select("name", "url").write.mode("overwrite").json(path)


def read_branch_lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("name STRING, url STRING").json(path)
    return rows.filter(F.col("url") != "").select(or_default(F.col("name"), F.col("url")).alias("name"), "url")
