"""HTML as a column of nodes.

A page becomes an array of nodes in document order; node ``pos`` covers the
positions up to ``last``, so a subtree is a slice of the array and everything
that follows (selectors, texts, rules) is an ordinary array expression.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from reviewloom.functions.binding import bind
from reviewloom.functions.text import strip

# the parser travels inside the tasks, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = ArrayType(
    StructType(
        [
            StructField("pos", IntegerType()),
            StructField("tag", StringType()),
            StructField("text", StringType()),
            StructField("attrs", MapType(StringType(), StringType())),
            StructField("classes", ArrayType(StringType())),
            StructField("parent", IntegerType()),
            StructField("last", IntegerType()),
            StructField("depth", IntegerType()),
        ]
    )
)

# Elements without an end tag, and those whose text is not page text.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr keygen menuitem "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
HIDDEN_TEXT = frozenset(("script", "style", "template"))
TEXT, HIDDEN, COMMENT, ERROR = "#text", "#hidden", "#comment", "#error"
_ASCII_SPACE = " \t\n\r\f\v"


class _Nodes(HTMLParser):
    """Collects [tag, text, attrs, parent, last, depth] per node of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self._open: list[int] = []
        self._open_tags: Counter[str] = Counter()
        self._pending: list[str] = []

    def _add(self, tag: str, text: str | None, attrs: dict[str, str]) -> int:
        pos = len(self.rows)
        self.rows.append([tag, text, attrs, self._open[-1] if self._open else None, pos, len(self._open)])
        return pos

    def _flush(self) -> None:
        text = "".join(self._pending)
        self._pending.clear()
        if not text:
            return
        if not text.strip(_ASCII_SPACE):
            text = "\n" if "\n" in text else " "
        hidden = self._open and self.rows[self._open[-1]][0] in HIDDEN_TEXT
        self._add(HIDDEN if hidden else TEXT, text, {})

    def _close(self) -> None:
        row = self.rows[self._open.pop()]
        row[4] = len(self.rows) - 1
        self._open_tags[row[0]] -= 1

    def handle_data(self, data: str) -> None:
        self._pending.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()
        self._add(COMMENT, data, {})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        pos = self._add(tag, None, {key: value or "" for key, value in attrs})
        if tag not in VOID:
            self._open.append(pos)
            self._open_tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._flush()
        self._add(tag, None, {key: value or "" for key, value in attrs})

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if self._open_tags[tag]:
            while self.rows[self._open[-1]][0] != tag:
                self._close()
            self._close()

    def finish(self) -> list[list]:
        self.close()
        self._flush()
        while self._open:
            self._close()
        return self.rows


def parse_page(html: str | None) -> list[dict] | None:
    if html is None:
        return None
    parser = _Nodes()
    try:
        parser.feed(html)
        rows = parser.finish()
    except (AssertionError, ValueError, IndexError, RecursionError) as error:
        # a page the parser gives up on is one node that says so; the pages around it go on
        rows = [[ERROR, type(error).__name__, {}, None, 0, 0]]
    return [
        {
            "pos": pos, "tag": tag, "text": text, "attrs": list(attrs.items()),
            "classes": attrs.get("class", "").split(), "parent": parent, "last": last, "depth": depth,
        }
        for pos, (tag, text, attrs, parent, last, depth) in enumerate(rows)
    ]


_ARROW_NODES = to_arrow_type(NODES)
# Characters of markup whose nodes a task holds at one time, unless a single page has more.
PIECE_CHARS = 1 << 20


def parsed_pieces(batches: Iterator[pa.Array], piece_chars: int = PIECE_CHARS) -> Iterator[pa.Array]:
    """The nodes of all pages in order, handed on in pieces: a task's memory does not grow with the pages of a batch."""
    for batch in batches:
        pages, chars = [], 0
        for html in batch:
            page = html.as_py()
            pages.append(parse_page(page))
            chars += len(page or "")
            if chars >= piece_chars:
                yield pa.array(pages, type=_ARROW_NODES)
                pages, chars = [], 0
        if pages:
            yield pa.array(pages, type=_ARROW_NODES)


@F.arrow_udf(NODES)
def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from parsed_pieces(batches)


def page_nodes(html: Column) -> Column:
    """Nodes of a page in document order."""
    return _parse(html)


# --- selectors and texts over nodes -------------------------------------------------


def has_class(node: Column, name: str) -> Column:
    return F.array_contains(node["classes"], name)


def any_class(node: Column, *names: str) -> Column:
    return F.arrays_overlap(node["classes"], F.array(*map(F.lit, names)))


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def has_attr(node: Column, name: str) -> Column:
    return F.map_contains_key(node["attrs"], name)


def is_element(node: Column) -> Column:
    return ~F.startswith(node["tag"], F.lit("#"))


def first_node(nodes: Column, test) -> Column:
    return F.get(F.filter(nodes, test), F.lit(0))


def subtree(nodes: Column, node: Column) -> Column:
    """The node and everything below it (``nodes`` may itself be a subtree)."""
    return F.slice(nodes, node["pos"] - nodes[0]["pos"] + 1, node["last"] - node["pos"] + 1)


def parent_of(nodes: Column, node: Column) -> Column:
    return F.get(nodes, node["parent"] - nodes[0]["pos"])


def text_of(nodes: Column, node: Column, separator: str = " ") -> Column:
    """Stripped page texts below a node, joined by the separator; null for no node."""

    def joined(found: Column) -> Column:
        texts = F.transform(F.filter(subtree(nodes, found), lambda n: n["tag"] == TEXT), lambda n: strip(n["text"]))
        return F.array_join(F.filter(texts, lambda t: t != ""), separator)

    return bind(node, joined)


def sole_text(nodes: Column, node: Column) -> Column:
    """Text of an element that holds nothing but one text, at any depth; else null."""
    chain = F.get(nodes, node["last"] - nodes[0]["pos"])
    is_chain = (node["last"] - node["pos"] == chain["depth"] - node["depth"]) & (node["last"] > node["pos"])
    return F.when(is_chain, chain["text"])
