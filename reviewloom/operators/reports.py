"""Reads behind the dashboard, the nested result and the run status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.binding import with_computed
from reviewloom.functions.text import is_blocked, keep_english
from reviewloom.operators.dedupe import first_n, keep_first

INSIGHT_COLUMNS = (
    "topic_id", "percentage", "top_keywords", "gemini_aspect", "gemini_sentiment", "gemini_summary",
    "gemini_recommendation",
)


def branch_insights(insights: DataFrame, meta: DataFrame, branch_id: int) -> DataFrame:
    """All stored topics of one branch, over all runs, by topic."""
    runs = meta.filter(F.col("branch_id") == branch_id).select("meta_id")
    return insights.join(runs, "meta_id").select(*INSIGHT_COLUMNS).orderBy("topic_id")


def all_insights(insights: DataFrame, meta: DataFrame) -> DataFrame:
    """The same read for every branch at once, for exports partitioned by branch."""
    return insights.join(meta.select("meta_id", "branch_id"), "meta_id").select("branch_id", *INSIGHT_COLUMNS)


def latest_runs(meta: DataFrame, n: int = 10) -> DataFrame:
    """The most recent run headers."""
    return meta.orderBy(F.desc_nulls_first("analysis_date"), F.desc("meta_id")).limit(n)


def _iso_time(time: Column) -> Column:
    """A time as text, with microseconds if it has any."""
    whole = F.date_trunc("second", time) == time
    return F.when(whole, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def nested_insights(insights: DataFrame, meta: DataFrame, n: int = 10) -> DataFrame:
    """Latest runs, each with its topics as an ordered array (empty without any)."""
    runs = latest_runs(meta, n).select("meta_id", "branch_id", "branch_name", "analysis_date")
    topic = F.struct(
        "topic_id",
        F.col("percentage").cast("double").alias("percentage"),
        "top_keywords",
        F.col("gemini_aspect").alias("aspect"),
        F.col("gemini_sentiment").alias("sentiment"),
        F.col("gemini_summary").alias("summary"),
        F.col("gemini_recommendation").alias("recommendation"),
    )
    # at most n runs take part, so their topics are few enough to nest
    topics = (
        insights.join(F.broadcast(runs.select("meta_id")), "meta_id", "left_semi")
        .groupBy("meta_id")
        .agg(F.array_sort(F.collect_list(topic)).alias("topics"))
    )
    empty = F.array().cast(topics.schema["topics"].dataType)
    return runs.join(topics, "meta_id", "left").select(
        "meta_id",
        "branch_id",
        "branch_name",
        _iso_time(F.col("analysis_date")).alias("analysis_date"),
        F.coalesce("topics", empty).alias("topics"),
    )


def branches_by_date(branches: DataFrame) -> DataFrame:
    """Branches, most recently collected first; those never collected come before all."""
    return branches.orderBy(F.desc_nulls_first("scraped_at"), "id")


def branch_choice(branches: DataFrame, keep: str = "oldest") -> DataFrame:
    """One id per branch name; of several branches with a name the oldest (or newest) counts."""
    order = {
        "oldest": [F.asc_nulls_last("scraped_at"), F.col("id")],
        "newest": [F.desc_nulls_first("scraped_at"), F.col("id")],
    }[keep]
    return keep_first(branches, ["name"], order).select("name", "id")


def reviews_by_branch(reviews: DataFrame, samples: int = 5) -> DataFrame:
    """Aggregated reviews of each branch: the report shown while there are no insights."""
    stars = [F.count_if(F.col("rating") == s).alias(f"stars_{s}") for s in range(1, 6)]
    totals = reviews.groupBy("branch_id").agg(
        F.count("*").alias("reviews"),
        F.count_if(F.col("rating") > 0).alias("rated"),
        F.round(F.avg(F.when(F.col("rating") > 0, F.col("rating"))), 4).alias("avg_rating"),
        *stars,
        F.min("scraped_at").alias("first_scraped"),
        F.max("scraped_at").alias("last_scraped"),
    )
    first = first_n(reviews.select("branch_id", "review_id", "text"), ["branch_id"], ["review_id"], samples)
    texts = first.groupBy("branch_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("review_id", "text"))), lambda r: r["text"]).alias("samples")
    )
    return totals.join(texts, "branch_id", "left")


def branch_verdicts(pages: DataFrame) -> DataFrame:
    """Per branch link: ``name, skipped, reason``, blocked at any snapshot being skipped.

    ``pages`` is ``(name, url, html, snapshot_no)`` with the first snapshot
    taken before and later ones after loading.
    """
    blocked = pages.select("name", "url", "snapshot_no", is_blocked(F.col("html")).alias("blocked"))
    verdict = blocked.groupBy("url").agg(
        F.max("name").alias("name"),
        F.bool_or("blocked").alias("skipped"),
        F.min(F.when(F.col("blocked"), F.col("snapshot_no"))).alias("_blocked_at"),
        F.min("snapshot_no").alias("_first"),
    )
    reason = F.when(F.col("_blocked_at") == F.col("_first"), "captcha").when(F.col("skipped"), "captcha_after_scroll")
    return verdict.select("url", "name", "skipped", reason.alias("reason"))


def collection_status(pages: DataFrame, found: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per branch: skipped and why, else how many reviews were found, how many of them are new, and pages not parsed.

    ``found`` is ``(url, found, new)``; ``errors`` has a row with ``url`` for every page that could not be parsed.
    """
    verdict = branch_verdicts(pages).join(found, "url", "left")
    if errors is not None:
        verdict = verdict.join(errors.groupBy("url").agg(F.count("*").alias("errors")), "url", "left")
    else:
        verdict = verdict.withColumn("errors", F.lit(0).cast("long"))
    count = lambda c: F.when(~F.col("skipped"), F.coalesce(c, F.lit(0))).alias(c)
    return verdict.select("name", "url", "skipped", "reason", count("found"), count("new"), count("errors"))


def completed_percent(status: DataFrame) -> DataFrame:
    """Whole percentage of branches handled without being skipped."""
    done, total = F.count_if(~F.col("skipped")), F.count("*")
    return status.agg(F.floor(done / F.greatest(F.lit(1), total) * 100).cast("int").alias("percent"))


def english_reviews(reviews: DataFrame, text_col: str = "text") -> DataFrame:
    """Reviews with their English part; those left empty are dropped."""
    cleaned = with_computed(reviews, text_col, keep_english(F.col(text_col)))
    return cleaned.filter(F.col(text_col) != "")


def cleaning_counts(reviews: DataFrame, by: Sequence[str], text_col: str = "text") -> DataFrame:
    """Found, kept and skipped reviews of the English cleaning, in one pass."""
    cleaned = with_computed(reviews, text_col, keep_english(F.col(text_col)))
    empty = F.coalesce(text_col, F.lit("")) == ""
    return cleaned.groupBy(*by).agg(
        F.count("*").alias("found"), F.count_if(~empty).alias("kept"), F.count_if(empty).alias("skipped")
    )


def distinct_ids(sightings: DataFrame, group: str, key: str, exact: bool = True) -> DataFrame:
    """Distinct review ids per branch; the approximate form needs no shuffle by id."""
    count = F.count_distinct(key) if exact else F.approx_count_distinct(key)
    return sightings.groupBy(group).agg(count.alias("ids"))


def topic_counts(topics: DataFrame, outlier: int = -1) -> DataFrame:
    """Reviews processed (outliers too) and topics found per branch."""
    found: Column = F.count_distinct(F.when(F.col("topic") != outlier, F.col("topic")))
    return topics.groupBy("branch_id").agg(F.count("*").alias("reviews"), found.alias("topics"))
