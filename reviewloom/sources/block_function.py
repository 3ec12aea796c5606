"""Review blocks of a page as a table function for SQL: ``FROM pages p, LATERAL review_blocks(p.html)``.

Two functions, one for each rule set of the place pages; they give the rows of
``review_blocks_v1`` and ``review_blocks_v2`` without the page's columns (the
second without its rating).  A page's nodes come from the same parser; the rules
are short look-ups over them, so that SQL users need no DataFrame code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from reviewloom.operators import extract as rules
from reviewloom.sources.markup import TEXT, parse_page

V1_SCHEMA = "block_no int, author string, label string, text string, date_raw string"
V2_SCHEMA = "block_no int, given_id string, author string, text string, date_raw string"
# Fixed value: what a date looks like, as in the column rules.
DATED = re.compile(
    r"\d+\s+(day|week|month|year)s?\s+ago|قبل\s+\d+\s+(يوم|اسبوع|شهر|سنة)|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}", re.I
)


class _Page:
    """Nodes of one page and the look-ups that the rules are made of."""

    def __init__(self, html: str | None) -> None:
        self.nodes = parse_page(html) or []
        for node in self.nodes:
            node["attrs"] = dict(node["attrs"])

    def below(self, block: dict) -> list[dict]:
        return self.nodes[block["pos"] + 1 : block["last"] + 1]

    def text(self, node: dict | None, separator: str = " ") -> str | None:
        if node is None:
            return None
        inside = self.nodes[node["pos"] : node["last"] + 1]
        return separator.join(t for t in (n["text"].strip() for n in inside if n["tag"] == TEXT) if t)


def _first(nodes: list[dict], test: Callable[[dict], bool]) -> dict | None:
    return next(filter(test, nodes), None)


def _element(node: dict) -> bool:
    return not node["tag"].startswith("#")


def _of_class(node: dict, *names: str) -> bool:
    return not set(names).isdisjoint(node["classes"])


def blocks_v1(html: str | None) -> Iterator[tuple]:
    """``block_no, author, label, text, date_raw`` by the first rule set."""
    page = _Page(html)
    chosen = (n for n in page.nodes if n["tag"] == "div" and rules.ID_ATTRIBUTE in n["attrs"])
    for number, block in enumerate(chosen):
        below = page.below(block)
        author = _first(below, lambda n: n["tag"] == "div" and " ".join(n["classes"]) == rules.V1_AUTHOR_CLASSES)
        stars = _first(below, lambda n: n["tag"] == "span" and n["attrs"].get("role") == "img")
        body = _first(below, lambda n: n["tag"] == "div" and rules.V1_TEXT_CLASS in n["classes"])
        date = _first(below, lambda n: n["tag"] == "span" and rules.V1_DATE_CLASS in n["classes"])
        name = page.text(author, "")
        yield (
            number, rules.UNKNOWN_AUTHOR if name is None else name, stars["attrs"].get("aria-label") if stars else None,
            page.text(body) or "", page.text(date) or "",
        )


def blocks_v2(html: str | None) -> Iterator[tuple]:
    """``block_no, given_id, author, text, date_raw`` by the second rule set."""
    page = _Page(html)
    divs = [n for n in page.nodes if n["tag"] == "div"]
    layouts = [[n for n in divs if rules.ID_ATTRIBUTE in n["attrs"]]]
    layouts += [[n for n in divs if _of_class(n, c)] for c in rules.FALLBACK_BLOCK_CLASSES]
    for number, block in enumerate(next(filter(None, layouts), [])):
        below = page.below(block)
        yield (
            number, block["attrs"].get(rules.ID_ATTRIBUTE), _author_v2(page, below), _text_v2(page, below), _date_v2(page, below),
        )


def _author_v2(page: _Page, below: list[dict]) -> str:
    def label(node: dict) -> str:
        return node["attrs"].get("aria-label", "")

    found = (
        _first(below, lambda n: _element(n) and (
            _of_class(n, *rules.V2_AUTHOR_CLASSES)
            or n["tag"] == "button" and "reviews" in label(n)
            or n["tag"] == "a" and "review" in " ".join(n["classes"])
        )),
        _first(below, lambda n: rules.V2_AUTHOR_ID in n["attrs"].get("id", "")),
        _first(below, lambda n: n["tag"] in ("button", "a") and label(n).lower().endswith("profile")),
    )
    return next(filter(None, (page.text(node, "") for node in found)), rules.UNKNOWN_AUTHOR)


def _text_v2(page: _Page, below: list[dict]) -> str:
    styled = _first(below, lambda n: _element(n) and (_of_class(n, *rules.V2_TEXT_CLASSES) or rules.V2_TEXT_ATTRIBUTE in n["attrs"]))
    if found := page.text(styled):
        return found
    longest = ""
    for node in below:
        # the text of a block never stands outside every element of it
        parent = page.nodes[node["parent"]] if node["parent"] is not None else None
        if _element(node) or parent is None or parent["tag"] in rules.V2_SKIPPED_PARENT_TAGS or _of_class(parent, *rules.V2_SKIPPED_PARENT_CLASSES):
            continue
        if len(text := node["text"].strip()) > len(longest):
            longest = text
    return longest


def _date_v2(page: _Page, below: list[dict]) -> str:
    styled = _first(below, lambda n: _element(n) and (
        n["tag"] == "time" or _of_class(n, *rules.V2_DATE_CLASSES) or rules.V2_DATE_ATTRIBUTE in n["attrs"]
    ))
    if found := page.text(styled):
        return found
    dated = _first(below, lambda n: not _element(n) and bool(DATED.search(n["text"])))
    return dated["text"].strip() if dated else ""


def _function(blocks: Callable[[str | None], Iterator[tuple]], schema: str):
    class ReviewBlocks:
        def eval(self, html: str):
            yield from blocks(html)

    # a plain function: Spark takes no Arrow function on the right of a lateral join
    return udtf(ReviewBlocks, returnType=schema, useArrow=False)


def register(spark: SparkSession) -> SparkSession:
    """Make ``review_blocks`` and ``review_blocks_v2`` known to the session's SQL."""
    spark.udtf.register("review_blocks", _function(blocks_v1, V1_SCHEMA))
    spark.udtf.register("review_blocks_v2", _function(blocks_v2, V2_SCHEMA))
    return spark
