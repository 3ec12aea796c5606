"""CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.reports import all_insights


def write_reviews_csv(reviews: DataFrame, path: str, append: bool = False) -> None:
    """Review rows as CSV; the folder is replaced unless ``append`` is set."""
    quoted = reviews.write.mode("append" if append else "overwrite").option("header", True)
    # doubled quotes and multi-line fields, so that any CSV reader gets the texts back
    quoted.option("escape", '"').csv(path)


def read_reviews_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


# Rows of one CSV file of the insights export.
FILE_ROWS = 500_000


def export_insights_csv(insights: DataFrame, meta: DataFrame, path: str, branch_id: int | None = None) -> None:
    """Insights of all branches in one job, or of one branch.

    Rows are dealt by ranges of branches and sorted, so a branch's rows stand
    together and no folder per branch is needed; a file holds ``FILE_ROWS`` rows
    at most, however many a branch has.  The branch is a column of the file.
    """
    rows = all_insights(insights, meta)
    if branch_id is not None:
        rows = rows.filter(F.col("branch_id") == branch_id)
    order = ["branch_id", "topic_id", "gemini_summary"]
    clustered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    quoted = clustered.write.mode("overwrite").option("header", True).option("escape", '"')
    quoted.option("maxRecordsPerFile", FILE_ROWS).csv(path)


def nested_json(nested: DataFrame) -> DataFrame:
    """Each nested run as one JSON text."""
    return nested.select(F.to_json(F.struct("branch_id", "branch_name", "analysis_date", "topics")).alias("value"))


def write_nested_json(nested: DataFrame, path: str) -> None:
    nested_json(nested).write.mode("overwrite").text(path)
