"""Collected pages, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewloom.schemas import PAGES


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages ``(page_id, url, html, snapshot_no, fetched_at)`` of a folder."""
    return spark.read.schema(PAGES).format(fmt).load(path)


def stream_pages(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """The same folder as a stream of arriving files."""
    reader = spark.readStream.schema(PAGES).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
