"""Reviews, places and links out of collected pages.

Pages are parsed once into a node column; every rule below is an array
expression on the nodes of a single review block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.binding import bind
from reviewloom.functions.dates import DATE_LIKE, relative_date
from reviewloom.functions.ratings import rating_from_label, rating_from_stars, rating_single_digit
from reviewloom.functions.text import is_blocked, or_default, snippet, strip, text_key
from reviewloom.functions.urls import is_place_link, place_id, unwrap_redirect
from reviewloom.operators.dedupe import first_n, keep_first
from reviewloom.sources.markup import (
    ERROR, TEXT, any_class, attr, first_node, has_attr, has_class, is_element, page_nodes, parent_of, sole_text, subtree,
    text_of,
)

# Markup of the known page layouts.
ID_ATTRIBUTE = "data-review-id"
FALLBACK_BLOCK_CLASSES = ("jftiEf", "hjmQqc", "VjjEkf")
V1_AUTHOR_CLASSES = "d4r55 fontTitleMedium"
V1_TEXT_CLASS = "MyEned"
V1_DATE_CLASS = "xRkPPb"
V2_AUTHOR_CLASSES = ("d4r55", "IaK8zc", "CVo7Bb", "kyCNSe", "PrHqRd", "NiCqic")
V2_AUTHOR_ID = "ml-reviews-page-user-review-name-"
V2_RATING_CLASSES = ("Rab10", "kvMYJc")
V2_RATING_CLASS_PAIR = ("fontBodyLarge", "fzvQIb")
V2_TEXT_CLASSES = ("wiI7pd", "d5K5Pd", "review-full-text")
V2_TEXT_ATTRIBUTE = "data-review-text"
V2_SKIPPED_PARENT_TAGS = ("button", "a")
V2_SKIPPED_PARENT_CLASSES = ("rating", "date", "time")
V2_DATE_CLASSES = ("xRkPPb", "bHyEBc", "dehysf", "review-date")
V2_DATE_ATTRIBUTE = "data-review-date"
ROUND_BLOCK_CLASSES = ("jftiEf", "MyEned", "section-review-content", "hjmQqc", "VjjEkf")
UNKNOWN_AUTHOR = "Unknown"
MIN_TEXT_LENGTH = 10
LONG_TEXT_LENGTH = 50


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _is_div(node: Column) -> Column:
    return node["tag"] == "div"


def _div_of_class(name: str):
    return lambda n: _is_div(n) & has_class(n, name)


def with_nodes(pages: DataFrame, *marks: str) -> DataFrame:
    """Pages with a ``nodes`` column in place of ``html``.

    With ``marks``, names of attributes in lower case, pages that contain none
    of them hold no block of interest and skip the parser.  Values cannot be
    such marks, since markup may write them with entities.
    """
    html = F.col("html")
    if marks:
        lowered = F.lower(html)
        html = F.when(reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(m)) for m in marks)), html)
    return pages.withColumn("nodes", page_nodes(html)).drop("html")


def explode_blocks(pages: DataFrame, chosen: Column, record: Callable[[Column, Column], Column]) -> DataFrame:
    """One row per chosen node: ``block_no`` from 0 and the fields of ``record(nodes, below)``.

    ``nodes`` is the subtree of the block, ``below`` the same without the block itself.
    """
    nodes = F.col("nodes")
    kept = [c for c in pages.columns if c != "nodes"]

    def of_block(block: Column) -> Column:
        return bind(
            subtree(nodes, block),
            lambda own: bind(F.slice(own, F.lit(2), F.size(own)), lambda below: record(own, below)),
        )

    # the outer form keeps the optimizer from evaluating the array a second time in a filter
    exploded = pages.select(*kept, F.posexplode_outer(F.transform(chosen, of_block)).alias("block_no", "record"))
    return exploded.filter(F.col("block_no").isNotNull()).select(*kept, "block_no", "record.*")


def page_errors(pages: DataFrame) -> DataFrame:
    """Pages that could not be parsed: ``page_id, url, error``."""
    failed = first_node(F.col("nodes"), lambda n: n["tag"] == ERROR)
    found = with_nodes(pages).select("page_id", "url", failed["text"].alias("error"))
    return found.filter(F.col("error").isNotNull())


def same_text(text: Column, opening: int | None = None) -> Column:
    """What makes two texts the same: all of them, or only their first characters if so many are given."""
    return text_key(text) if opening is None else snippet(text, opening)


def _first(rows: DataFrame, keys: list, order: list, limit: int | None) -> DataFrame:
    return rows if limit is None else first_n(rows, keys, order, limit)


def _first_non_empty(*arrays: Column) -> Column:
    return reduce(lambda rest, a: F.when(F.size(a) > 0, a).otherwise(rest), reversed(arrays))


# --- place pages, first rule set ------------------------------------------------------


def _record_v1(nodes: Column, below: Column) -> Column:
    author = first_node(below, lambda n: _is_div(n) & (F.array_join(n["classes"], " ") == V1_AUTHOR_CLASSES))
    stars = first_node(below, lambda n: (n["tag"] == "span") & (attr(n, "role") == "img"))
    body = first_node(below, lambda n: _is_div(n) & has_class(n, V1_TEXT_CLASS))
    date = first_node(below, lambda n: (n["tag"] == "span") & has_class(n, V1_DATE_CLASS))
    return F.struct(
        F.coalesce(text_of(nodes, author, ""), F.lit(UNKNOWN_AUTHOR)).alias("author"),
        attr(stars, "aria-label").alias("label"),
        _blank(text_of(nodes, body)).alias("text"),
        _blank(text_of(nodes, date)).alias("date_raw"),
    )


def review_blocks_v1(pages: DataFrame) -> DataFrame:
    """Every ``div`` carrying a review id, nested ones included, with the texts of its parts."""
    chosen = F.filter(F.col("nodes"), lambda n: _is_div(n) & has_attr(n, ID_ATTRIBUTE))
    return explode_blocks(with_nodes(pages, ID_ATTRIBUTE), chosen, _record_v1)


def parsed_v1(pages: DataFrame, min_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Every usable review block of the pages, row by row (also for streams).

    A block with a shorter text is left out; a date that cannot be computed stays as it was read.
    """
    blocks = review_blocks_v1(pages.filter(~is_blocked(F.col("html"))))
    kept = [c for c in pages.columns if c != "html"]
    return blocks.filter(F.length("text") >= min_length).select(
        *kept,
        "block_no",
        "author",
        F.coalesce(rating_single_digit(F.col("label")), F.lit(0)).alias("rating"),
        "text",
        _review_date(),
    )


def _review_date() -> Column:
    raw = F.col("date_raw")
    return F.coalesce(relative_date(raw, F.col("fetched_at")), strip(raw)).alias("review_date")


def reviews_v1(pages: DataFrame, max_reviews: int | None = None, opening: int | None = None) -> DataFrame:
    """``author, rating, text, review_date`` of each page's reviews, or of the first so many.

    Repeats of a text are left out before the limit applies; with ``opening`` two
    texts are the same when their first characters are.
    """
    unique = keep_first(parsed_v1(pages), ["page_id", same_text(F.col("text"), opening)], ["block_no"])
    return _first(unique, ["page_id"], ["block_no"], max_reviews)


# --- place pages, second rule set -----------------------------------------------------


def _record_v2(nodes: Column, below: Column) -> Column:
    return F.struct(
        attr(nodes[0], ID_ATTRIBUTE).alias("given_id"),
        _author_v2(nodes, below).alias("author"),
        _rating_v2(nodes, below).alias("rating"),
        _text_v2(nodes, below).alias("text"),
        _date_v2(nodes, below).alias("date_raw"),
    )


def review_blocks_v2(pages: DataFrame) -> DataFrame:
    """Blocks of the first layout that yields any: by review id, else by one of three classes."""
    nodes = F.col("nodes")
    by_id = F.filter(nodes, lambda n: _is_div(n) & has_attr(n, ID_ATTRIBUTE))
    by_class = [F.filter(nodes, _div_of_class(c)) for c in FALLBACK_BLOCK_CLASSES]
    return explode_blocks(with_nodes(pages), _first_non_empty(by_id, *by_class), _record_v2)


def _author_v2(nodes: Column, below: Column) -> Column:
    styled = first_node(
        below,
        lambda n: is_element(n)
        & (
            any_class(n, *V2_AUTHOR_CLASSES)
            | ((n["tag"] == "button") & F.contains(_blank(attr(n, "aria-label")), F.lit("reviews")))
            | ((n["tag"] == "a") & F.contains(F.array_join(n["classes"], " "), F.lit("review")))
        ),
    )
    named = first_node(below, lambda n: F.contains(_blank(attr(n, "id")), F.lit(V2_AUTHOR_ID)))
    profile = first_node(
        below,
        lambda n: n["tag"].isin("button", "a") & F.endswith(F.lower(_blank(attr(n, "aria-label"))), F.lit("profile")),
    )
    steps = [F.nullif(text_of(nodes, n, ""), F.lit("")) for n in (styled, named, profile)]
    return F.coalesce(*steps, F.lit(UNKNOWN_AUTHOR))


def _rating_v2(nodes: Column, below: Column) -> Column:
    labelled = first_node(
        below, lambda n: (attr(n, "role") == "img") & F.rlike(_blank(attr(n, "aria-label")), F.lit(r"\p{Nd}"))
    )
    styled = first_node(
        below,
        lambda n: is_element(n)
        & (
            any_class(n, *V2_RATING_CLASSES)
            | (has_class(n, V2_RATING_CLASS_PAIR[0]) & has_class(n, V2_RATING_CLASS_PAIR[1]))
            | (
                _is_div(n)
                & (_blank(attr(n, "role")) == "img")
                & F.contains(_blank(attr(n, "aria-label")), F.lit("stars"))
            )
        ),
    )
    numbers = F.transform(
        F.filter(below, lambda n: ~is_element(n) & F.rlike(n["text"], F.lit("[1-5]"))),
        lambda n: rating_from_label(n["text"]),
    )
    return F.coalesce(
        rating_from_label(attr(labelled, "aria-label")),
        rating_from_label(F.coalesce(attr(styled, "aria-label"), text_of(nodes, styled, ""))),
        F.get(F.filter(numbers, lambda r: r > 0), F.lit(0)),
        F.lit(0),
    )


def _text_v2(nodes: Column, below: Column) -> Column:
    styled = first_node(below, lambda n: is_element(n) & (any_class(n, *V2_TEXT_CLASSES) | has_attr(n, V2_TEXT_ATTRIBUTE)))
    free = F.filter(
        below,
        lambda n: ~is_element(n)
        & ~parent_of(nodes, n)["tag"].isin(*V2_SKIPPED_PARENT_TAGS)
        & ~any_class(parent_of(nodes, n), *V2_SKIPPED_PARENT_CLASSES),
    )
    longest = F.aggregate(
        F.transform(free, lambda n: strip(n["text"])),
        F.lit(""),
        lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best),
    )
    return F.coalesce(F.nullif(text_of(nodes, styled), F.lit("")), longest)


def _date_v2(nodes: Column, below: Column) -> Column:
    styled = first_node(
        below,
        lambda n: is_element(n) & ((n["tag"] == "time") | any_class(n, *V2_DATE_CLASSES) | has_attr(n, V2_DATE_ATTRIBUTE)),
    )
    dated = first_node(below, lambda n: ~is_element(n) & F.rlike(n["text"], F.lit(DATE_LIKE)))
    return F.coalesce(F.nullif(text_of(nodes, styled), F.lit("")), strip(dated["text"]), F.lit(""))


def review_key(given: Column, text: Column, author: Column, opening: int | None = None) -> Column:
    """The review id of the markup, else one made of the author and the text, or its first characters."""
    label = "text:" if opening is None else "snippet:"
    made = F.concat(F.lit(label), same_text(text, opening), F.lit("|author:"), author)
    return or_default(given, made)


def parsed_v2(pages: DataFrame, min_length: int = MIN_TEXT_LENGTH, opening: int | None = None) -> DataFrame:
    """Every usable review block with ``review_id`` and ``date_raw``, row by row (also for streams)."""
    blocks = review_blocks_v2(pages.filter(~is_blocked(F.col("html"))))
    kept = [c for c in pages.columns if c != "html"] + ["block_no"]
    usable = blocks.filter(F.length("text") >= min_length)
    return usable.select(
        *kept,
        review_key(F.col("given_id"), F.col("text"), F.col("author"), opening).alias("review_id"),
        "author",
        "rating",
        "text",
        _review_date(),
        "date_raw",
        F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"),
    )


def reviews_v2(pages: DataFrame, max_reviews: int | None = None) -> DataFrame:
    """The reviews of each page, or the first so many; repeats of an id are left out before the limit."""
    unique = keep_first(parsed_v2(pages), ["page_id", "review_id"], ["block_no"])
    return _first(unique, ["page_id"], ["block_no"], max_reviews)


# --- search pages ---------------------------------------------------------------------


def _head(text: Column, length: int | None) -> Column:
    return text if length is None else F.substring(text, 1, length)


def _search_reviews(nodes: Column, max_blocks: int | None, max_text: int | None) -> Column:
    """The reviews of one search page as an array of structs."""
    rated = F.filter(nodes, lambda n: _is_div(n) & F.contains(_blank(attr(n, "aria-label")), F.lit("Rated")))
    long_texts = F.filter(nodes, lambda n: _is_div(n) & (F.length(sole_text(nodes, n)) > LONG_TEXT_LENGTH))

    def author(links: Column, block: Column) -> Column:
        last = F.try_element_at(F.filter(links, lambda n: n["pos"] < block["pos"]), F.lit(-1))
        return F.coalesce(text_of(nodes, last, ""), F.lit(UNKNOWN_AUTHOR))

    blocks = _first_non_empty(rated, long_texts)
    chosen = blocks if max_blocks is None else F.slice(blocks, F.lit(1), F.lit(max_blocks))

    def records(links: Column) -> Column:
        return F.transform(
            chosen,
            lambda b: F.struct(
                author(links, b).alias("author"),
                F.coalesce(rating_from_stars(attr(b, "aria-label")), F.lit(0)).alias("rating"),
                _head(text_of(nodes, b), max_text).alias("text"),
                F.lit("").alias("review_date"),
            ),
        )

    # the links of a page are looked for once, not in all nodes before every block
    return bind(F.filter(nodes, lambda n: n["tag"].isin("div", "span") & (attr(n, "role") == "link")), records)


def place_records(pages: DataFrame, max_blocks: int | None = None, max_text: int | None = None) -> DataFrame:
    """One nested record per page: title, link, place id, reviews and source.

    ``max_blocks`` limits the reviews of a page, ``max_text`` the characters of a review and of the source.
    """
    head = pages.withColumn("raw_html", _head(F.col("html"), max_text))
    parsed = head.withColumn("nodes", page_nodes(F.col("html")))
    nodes = F.col("nodes")
    title = text_of(nodes, first_node(nodes, lambda n: n["tag"] == "title"))
    return parsed.select(
        "page_id",
        _blank(title).alias("name"),
        "url",
        place_id(F.col("url")).alias("place_id"),
        _search_reviews(nodes, max_blocks, max_text).alias("reviews"),
        "raw_html",
    )


def reviews_search(pages: DataFrame, max_blocks: int | None = None, max_text: int | None = None) -> DataFrame:
    """The reviews of :func:`place_records`, one per row."""
    return (
        place_records(pages, max_blocks, max_text)
        .select("page_id", "url", F.posexplode_outer("reviews").alias("block_no", "review"))
        .filter(F.col("block_no").isNotNull())
        .select("page_id", "url", "block_no", "review.*")
    )


def links(pages: DataFrame) -> DataFrame:
    """Every link of a page with its position: ``page_id, url, link_no, href``."""
    hrefs = F.transform(
        F.filter(F.col("nodes"), lambda n: (n["tag"] == "a") & has_attr(n, "href")), lambda n: attr(n, "href")
    )
    return (
        with_nodes(pages, "href")
        .select("page_id", "url", F.posexplode_outer(hrefs).alias("link_no", "href"))
        .filter(F.col("link_no").isNotNull())
    )


def place_links(pages: DataFrame, max_places: int | None = None) -> DataFrame:
    """Unwrapped links to places, distinct in first-seen order; all of a page or the first so many."""
    found = links(pages).filter(is_place_link(F.col("href"))).withColumn("href", unwrap_redirect(F.col("href")))
    return _first(keep_first(found, ["page_id", "href"], ["link_no"]), ["page_id"], ["link_no"], max_places)


# --- ids and counts while a page grows -------------------------------------------------


def _round_blocks(nodes: Column) -> Column:
    return F.filter(
        nodes,
        lambda n: _is_div(n)
        & (has_attr(n, ID_ATTRIBUTE) | any_class(n, *ROUND_BLOCK_CLASSES) | (_blank(attr(n, "role")) == "article")),
    )


def modal_review_ids(pages: DataFrame, min_length: int = 10) -> DataFrame:
    """Ids of the blocks in a review dialog; ids of up to ten characters are left out."""

    def record(nodes: Column, below: Column) -> Column:
        stars = first_node(below, lambda n: F.contains(_blank(attr(n, "aria-label")), F.lit("star")))
        author = first_node(
            below,
            lambda n: F.contains(_blank(attr(n, "class")), F.lit("author"))
            | F.contains(_blank(attr(n, "class")), F.lit("name")),
        )
        made = F.concat(
            text_of(nodes, nodes[0]), F.lit("|"), _blank(attr(stars, "aria-label")), F.lit("|"),
            _blank(text_of(nodes, author)),
        )
        given = or_default(attr(nodes[0], ID_ATTRIBUTE), attr(nodes[0], "data-reviewid"))
        return F.struct(or_default(given, made).alias("review_key"))

    blocks = explode_blocks(with_nodes(pages), _round_blocks(F.col("nodes")), record)
    return blocks.filter(F.length("review_key") > min_length)


def live_review_ids(pages: DataFrame) -> DataFrame:
    """Ids seen while scrolling a place page: the id attribute, else the text."""
    chosen = F.filter(
        F.col("nodes"), lambda n: _is_div(n) & (has_attr(n, ID_ATTRIBUTE) | any_class(n, *FALLBACK_BLOCK_CLASSES))
    )

    def record(nodes: Column, below: Column) -> Column:
        given = or_default(attr(nodes[0], ID_ATTRIBUTE), attr(nodes[0], "data-reviewid"))
        return F.struct(or_default(given, text_of(nodes, nodes[0])).alias("review_key"))

    blocks = explode_blocks(with_nodes(pages), chosen, record)
    return blocks.filter(F.col("review_key") != "")


def loaded_counts(pages: DataFrame) -> DataFrame:
    """Per page: review blocks in the markup, and those that look filled in."""
    nodes = F.col("nodes")
    blocks = F.filter(
        nodes, lambda n: _is_div(n) & (has_attr(n, ID_ATTRIBUTE) | any_class(n, *FALLBACK_BLOCK_CLASSES))
    )

    def filled(block: Column) -> Column:
        inside = subtree(nodes, block)
        texts = F.transform(F.filter(inside, lambda n: n["tag"] == TEXT), lambda n: n["text"])
        starred = F.exists(
            inside, lambda n: (n["tag"] == "span") & F.contains(_blank(attr(n, "aria-label")), F.lit("stars"))
        )
        return (F.length(F.array_join(texts, "")) > 20) | starred

    found = with_nodes(pages).withColumn("blocks", blocks)
    count = lambda a: F.coalesce(F.nullif(F.size(a), F.lit(-1)), F.lit(0))
    return found.select(
        "page_id",
        "url",
        count(F.col("blocks")).alias("blocks"),
        count(F.filter("blocks", filled)).alias("filled_blocks"),
    )


def left_out_blocks(pages: DataFrame, layout: int = 1, min_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Per page with blocks: how many there are, and how many are left out because their text is too short."""
    blocks = review_blocks_v1(pages) if layout == 1 else review_blocks_v2(pages)
    short = F.length(F.coalesce("text", F.lit(""))) < min_length
    return blocks.groupBy("page_id", "url").agg(F.count("*").alias("blocks"), F.count_if(short).alias("left_out"))
