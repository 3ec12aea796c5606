"""Collect, normalise, analyse: the three stages of a run.

The stored tables are the only state between stages, and each stage handles
all branches in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import is_arabic, normalize_simple
from reviewloom.functions.urls import place_id
from reviewloom.operators.analysis import analysis_requests, analysis_results, run_headers
from reviewloom.operators.changes import StageDigests
from reviewloom.operators.dedupe import first_n, keep_first, null_safe
from reviewloom.operators.extract import page_errors, parsed_v1, parsed_v2, place_records, same_text
from reviewloom.operators.language import LanguageModel, detect_language, translate_from
from reviewloom.operators.reports import branch_verdicts, collection_status, english_reviews, nested_insights, reviews_by_branch
from reviewloom.operators.topics import TopicSettings, all_outliers, assign_topics
from reviewloom.operators.upsert import (
    assign_ids, new_reviews, next_id, split_oversize, upsert, upsert_branches_by_place, upsert_branches_by_url,
)
from reviewloom.schemas import WIDTHS
from reviewloom.session import broadcast_if_small, cut, land
from reviewloom.sinks.store import ReviewStore
from reviewloom.sources.tables import branch_ids_of, normalized_texts, reviews_for_normalising


@dataclass(frozen=True)
class RunOptions:
    """What a user may switch on, off or limit."""

    max_reviews: int | None = None
    layout: int = 1
    keep_english: bool = False
    detect: LanguageModel | None = None
    model_topics: bool = True
    analyse: bool = True
    topics: TopicSettings = TopicSettings()


def collect(store: ReviewStore, branches: DataFrame, pages: DataFrame, options: RunOptions, run: str) -> DataFrame:
    """Store the branches and new reviews of the pages; returns the status per branch.

    ``branches`` is ``(name, url)``; ``pages`` follows :data:`reviewloom.schemas.PAGES`.
    A branch that was blocked at any snapshot is skipped whole: it is neither
    stored nor dated and none of its reviews are.  Reviews with a value wider
    than its column are set aside with the names of those columns.
    """
    names = broadcast_if_small(land(branches.select("name", "url").dropDuplicates(["url"]), "names"))
    # the pages are made and named once; verdicts, reviews, errors and dates read them as written
    named = land(pages.join(names, "url"), "named", "zstd")
    good, found = collected_reviews(named, options)
    found = land(found, "found", "zstd")
    seen = good.groupBy("url", "name").agg(F.max("fetched_at").alias("scraped_at"))
    store.replace("branches", upsert_branches_by_url(store.read("branches"), seen, ["scraped_at", "name"]))
    rows = branch_ids_of(found, store.read("branches")).withColumn("scraped_at", F.col("fetched_at"))
    part = f"run-{run}"
    fits, rejected = split_oversize(rows, WIDTHS["reviews"])
    fresh = land(new_reviews(fits, store.read("reviews", without_part=part), ["snapshot_no", "page_id", "block_no"]), "new", "zstd")
    store.append("reviews", fresh, part)
    store.reject("reviews", rejected.select("url", "author", "text", "review_date", "oversize"), part)
    links = store.read("branches").select(F.col("id").alias("branch_id"), "url")
    added = fresh.groupBy("branch_id").agg(F.count("*").alias("new")).join(links, "branch_id").select("url", "new")
    counts = found.groupBy("url").agg(F.count("*").alias("found")).join(added, "url", "left")
    return collection_status(named, counts, page_errors(named))


def collected_reviews(named: DataFrame, options: RunOptions) -> tuple[DataFrame, DataFrame]:
    """The pages of branches that were never blocked, and their reviews, each once per branch.

    Snapshots accumulate: of a review seen more than once the first sighting
    counts.  A limit applies to the reviews of a branch.
    """
    passed = broadcast_if_small(land(branch_verdicts(named).filter(~F.col("skipped")).select("url"), "passed"))
    good = named.join(passed, "url", "left_semi")
    if options.layout == 1:
        parsed = parsed_v1(good).withColumn("_key", same_text(F.col("text")))
    else:
        parsed = parsed_v2(good).withColumn("_key", F.col("review_id"))
    if options.keep_english:
        parsed = english_reviews(parsed)
    order = ["snapshot_no", "page_id", "block_no"]
    unique = keep_first(parsed, ["url", "_key"], order).drop("_key")
    return good, unique if options.max_reviews is None else first_n(unique, ["url"], order, options.max_reviews)


def review_rows(named: DataFrame, options: RunOptions = RunOptions(layout=2, keep_english=True)) -> DataFrame:
    """Collected reviews as rows of the review CSV: second layout, English part, named by branch."""
    _, found = collected_reviews(named, options)
    return found.select(
        F.col("name").alias("branch_name"), F.col("url").alias("branch_url"), "review_id", "author", "rating", "text",
        "review_date", "date_raw", "scraped_at",
    )


def collect_places(store: ReviewStore, pages: DataFrame, run: str) -> DataFrame:
    """The search flow: place records become branches by place id or link, their reviews are added; returns the status.

    A link that was blocked at any snapshot is skipped whole.  Reviews with a
    value wider than its column are set aside with the names of those columns.
    The status has a row per link: found and new reviews, and pages not parsed.
    """
    named = pages.withColumn("name", F.col("url"))
    passed = branch_verdicts(named).filter(~F.col("skipped")).select("url")
    good = pages.join(passed, "url", "left_semi")
    records = land(place_records(good).join(good.select("page_id", "fetched_at", "snapshot_no"), "page_id"), "places")
    batch = records.select("name", "url", F.col("fetched_at").alias("scraped_at"))
    store.replace("branches", upsert_branches_by_place(store.read("branches"), batch, ["scraped_at", "name", "url"]))
    found = records.select("url", "page_id", "snapshot_no", "fetched_at", F.posexplode("reviews").alias("block_no", "review"))
    known = store.read("branches").select(F.col("place_id").alias("_place"), F.col("id").alias("_by_place"))
    rows = found.select("*", "review.*", place_id(F.col("url")).alias("_place")).drop("review")
    rows = branch_ids_of(rows, store.read("branches")).join(known.groupBy("_place").agg(F.min("_by_place").alias("_by_place")), "_place", "left")
    rows = land(rows.withColumn("branch_id", F.coalesce("branch_id", "_by_place")).withColumn("scraped_at", F.col("fetched_at")), "place-rows")
    part = f"run-{run}"
    fits, rejected = split_oversize(rows, WIDTHS["reviews"])
    fresh = land(new_reviews(fits, store.read("reviews", without_part=part), ["snapshot_no", "page_id", "block_no"]), "new")
    store.append("reviews", fresh, part)
    store.reject("reviews", rejected.select("url", "author", "text", "review_date", "oversize"), part)
    # a new review counts for the link whose block was kept, the first of its branch
    keys = ["branch_id", "text"]
    firsts = keep_first(fits, keys, ["snapshot_no", "page_id", "block_no"]).select("url", *keys)
    added = null_safe(firsts, fresh, keys, "left_semi").groupBy("url").agg(F.count("*").alias("new"))
    counts = rows.groupBy("url").agg(F.count("*").alias("found")).join(added, "url", "left")
    return collection_status(named, counts, page_errors(named))


def normalise(
    store: ReviewStore,
    memory: DataFrame,
    needs: Callable[[Column], Column] = is_arabic,
    model: LanguageModel | None = None,
    foreign: Sequence[str] = ("ar",),
    simple: bool = False,
    digests: StageDigests | None = None,
) -> DataFrame | None:
    """Refresh the normalised reviews from the reviews table and the translation memory.

    With ``digests`` only branches whose reviews have changed since the stage
    last ran are worked on; the changes are returned, and where there are none
    nothing is written.

    Which texts want a translation is told by ``needs``, a test of the script,
    or by a fitted language ``model`` and the ``foreign`` languages.  ``simple``
    is the fallback without any translation: one line in lower case.
    """
    if digests is not None:
        def work(moved: DataFrame, gone: DataFrame) -> None:
            _normalise(store, moved, gone, memory, needs, model, foreign, simple)

        return digests.run("normalise", store.read("reviews"), work)
    _normalise(store, store.read("reviews"), None, memory, needs, model, foreign, simple)
    return None


def _normalise(
    store: ReviewStore, reviews: DataFrame, gone: DataFrame | None, memory: DataFrame, needs: Callable[[Column], Column],
    model: LanguageModel | None, foreign: Sequence[str], simple: bool,
) -> None:
    rows = reviews_for_normalising(reviews)
    if simple:
        translated = rows.withColumn("normalized_text", normalize_simple(F.col("original_text")))
    elif model is not None:
        guessed = detect_language(rows, model, "original_text")
        translated = translate_from(guessed, memory, F.col("lang_guess").isin(*foreign)).drop("lang_guess")
    else:
        translated = translate_from(rows, memory, needs(F.col("original_text")))
    stored = store.read("normalized_reviews")
    if gone is not None:
        stored = null_safe(stored, gone, ["branch_id"], "left_anti")
    store.replace("normalized_reviews", upsert(stored, translated, ["review_id"], ["scraped_at"]))


def find_topics(store: ReviewStore, options: RunOptions) -> DataFrame:
    """Every normalised review with its topic (-1 throughout when modelling is off)."""
    reviews = normalized_texts(store.read("normalized_reviews"))
    chosen = assign_topics(reviews, options.topics) if options.model_topics else all_outliers(reviews)
    return reviews.join(chosen, ["branch_id", "review_id"])


def save_insights(store: ReviewStore, topics: DataFrame, responses: DataFrame, options: RunOptions, run: str) -> None:
    """Store one header and its topics per branch with results; branches without any are left out.

    Topics are written first and readers join on the header, so half a run is
    never visible; both parts carry the run's name and can be written again.
    """
    part = f"run-{run}"
    results = cut(analysis_results(analysis_requests(topics, options.topics), responses))
    stored = store.read("insights_meta", without_part=part)
    headers = run_headers(topics, results, store.read("branches"), options.topics)
    headers = cut(assign_ids(headers, ["branch_id"], "meta_id", next_id(stored, "meta_id")))
    details = results.join(headers.select("branch_id", "meta_id"), "branch_id").withColumnRenamed("topic", "topic_id")
    first = next_id(store.read("insights", without_part=part), "insight_id")
    store.append("insights", assign_ids(details, ["meta_id", "topic_id"], "insight_id", first), part)
    store.append("insights_meta", headers.withColumn("analysis_date", F.current_timestamp()), part)


def run(
    store: ReviewStore,
    branches: DataFrame,
    pages: DataFrame,
    memory: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    name: str,
    options: RunOptions = RunOptions(),
) -> DataFrame:
    """All stages in order; a stage that fails stops the run.  Returns the collection status.

    ``answer`` turns the request table into the response table
    ``(branch_id, topic_id, reply, error)``; how it reaches a model is its own affair.
    """
    store.ensure()
    status = collect(store, branches, pages, options, name)
    normalise(store, memory, model=options.detect)
    topics = cut(find_topics(store, options))
    if options.model_topics and options.analyse:
        save_insights(store, topics, answer(analysis_requests(topics, options.topics)), options, name)
    return status


def stored_insights(store: ReviewStore, n: int = 20) -> tuple[str, DataFrame]:
    """Latest insights, or aggregated reviews while there are none, with the kind of result."""
    meta = store.read("insights_meta")
    if meta.isEmpty():
        return "aggregated_reviews", reviews_by_branch(store.read("reviews"))
    return "insights_table", nested_insights(store.read("insights"), meta, n)


def insights_or_run(store: ReviewStore, compute: Callable[[], object], n: int = 20) -> tuple[str, DataFrame]:
    """Stored insights if there are any; otherwise run first, then read again."""
    if store.read("insights_meta").isEmpty():
        compute()
    return stored_insights(store, n)
