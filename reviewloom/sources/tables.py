"""Reads of the review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jdbc(spark: SparkSession, url: str, table: str, split_on: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """Parallel read of a database table; driver and credentials come from the caller."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=split_on, lowerBound=low, upperBound=high, numPartitions=parts
    )
    return reader.options(**options).load()


def reviews_for_normalising(reviews: DataFrame, branch_id: int | None = None) -> DataFrame:
    """All reviews, or those of one branch, with the text named ``original_text``."""
    if branch_id is not None:
        reviews = reviews.filter(F.col("branch_id") == branch_id)
    return reviews.select(
        "review_id", "branch_id", "author", "rating", F.col("text").alias("original_text"), "review_date", "scraped_at"
    )


def normalized_texts(normalized: DataFrame, branch_id: int | None = None) -> DataFrame:
    """``(branch_id, review_id, normalized_text)``, for one branch or for all at once."""
    if branch_id is not None:
        normalized = normalized.filter(F.col("branch_id") == branch_id)
    return normalized.select("branch_id", "review_id", "normalized_text")


def branch_ids_of(urls: DataFrame, branches: DataFrame) -> DataFrame:
    """The branch each link belongs to: the one with the lowest id when a link is stored twice."""
    known = branches.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("id").alias("branch_id"))
    return urls.join(known, "url", "left")
