"""Declared schemas of the stored tables and exchanged files."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DecimalType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
    TimestampType,
)

_KINDS = {
    "long": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType(),
    "timestamp": TimestampType(), "timestamp_ntz": TimestampNTZType(), "percent": DecimalType(5, 2),
}


def _table(**columns: str) -> StructType:
    """Columns by kind; a trailing ``!`` marks a column that is never null."""
    return StructType([StructField(n, _KINDS[k.rstrip("!")], not k.endswith("!")) for n, k in columns.items()])


BRANCHES = _table(
    id="long", name="string!", address="string", place_id="string", phone="string", lat="string", lng="string",
    url="string", scraped_at="timestamp",
)
REVIEWS = _table(
    review_id="long", branch_id="long", author="string", rating="int", text="string", review_date="string",
    scraped_at="timestamp",
)
NORMALIZED_REVIEWS = _table(
    review_id="long", branch_id="long", author="string", rating="int", original_text="string",
    normalized_text="string", review_date="string", scraped_at="timestamp_ntz",
)
INSIGHTS_META = _table(
    meta_id="long", branch_id="long!", branch_name="string!", analysis_date="timestamp",
    number_of_reviews_processed="int!", number_of_topics="int!", bertopic_parameters="string",
)
INSIGHTS = _table(
    insight_id="long", meta_id="long!", topic_id="int!", percentage="percent!", top_keywords="string",
    gemini_aspect="string", gemini_sentiment="string", gemini_summary="string", gemini_recommendation="string",
)
REVIEW_CSV = _table(
    branch_name="string", branch_url="string", review_id="string", author="string", rating="int", text="string",
    review_date="string", date_raw="string", scraped_at="string",
)
INSIGHTS_CSV = _table(
    branch_id="long", topic_id="int", percentage="percent", top_keywords="string", gemini_aspect="string",
    gemini_sentiment="string", gemini_summary="string", gemini_recommendation="string",
)
COLLECTION_STATUS = _table(
    name="string", url="string", skipped="boolean", reason="string", found="long", new="long", errors="long"
)
PAGES = _table(page_id="long", url="string", html="string", snapshot_no="int", fetched_at="timestamp")
ANALYSIS_RESPONSES = _table(branch_id="long", topic_id="int", reply="string", error="string")

TABLES = {
    "branches": BRANCHES,
    "reviews": REVIEWS,
    "normalized_reviews": NORMALIZED_REVIEWS,
    "insights_meta": INSIGHTS_META,
    "insights": INSIGHTS,
}

# Fixed column widths of the stored tables (characters).
WIDTHS = {
    "branches": {"name": 512, "address": 512, "place_id": 1024, "phone": 64, "lat": 64, "lng": 64, "url": 1024},
    "reviews": {"author": 256, "review_date": 64},
    "normalized_reviews": {"author": 256, "review_date": 64},
    "insights_meta": {"branch_name": 255},
    "insights": {"gemini_aspect": 255, "gemini_sentiment": 50},
}
