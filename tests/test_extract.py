"""Extraction rules on hand-written pages."""

import datetime as dt
from hashlib import sha256

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import extract
from reviewloom.sources.markup import page_nodes, parsed_pieces

NOW = dt.datetime(2025, 10, 15, 12, 0)


@pytest.fixture
def pages(spark):
    def make(*htmls):
        rows = [(i, f"https://h/p/{i}", html, 0, NOW) for i, html in enumerate(htmls)]
        return spark.createDataFrame(rows, "page_id long, url string, html string, snapshot_no int, fetched_at timestamp")

    return make


def v1_block(rid, text, author="Ann", stars="5 stars", date="2 weeks ago"):
    name = f'<div class="d4r55 fontTitleMedium"> {author} </div>' if author else ""
    rating = f'<span role="img" aria-label="{stars}"></span>' if stars else ""
    when = f'<span class="xRkPPb">{date}</span>' if date else ""
    return f'<div data-review-id="{rid}">{name}{rating}{when}<div class="MyEned"><span>{text}</span></div></div>'


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("page_id", "block_no").select(*columns).collect()]


def test_nodes_follow_document_order(spark):
    html = '<div id=a class="x  y">t<br>u<p>one<p>two</div>&amp;<script>s<b></script><!--c--><i/>z</em>'
    nodes = spark.createDataFrame([(html,)], "html string").select(page_nodes(F.col("html")).alias("n")).first().n
    got = [(n.pos, n.tag, n.text, n.parent, n.last, n.depth) for n in nodes]
    assert got == [
        (0, "div", None, None, 7, 0), (1, "#text", "t", 0, 1, 1), (2, "br", None, 0, 2, 1), (3, "#text", "u", 0, 3, 1),
        (4, "p", None, 0, 7, 1), (5, "#text", "one", 4, 5, 2), (6, "p", None, 4, 7, 2), (7, "#text", "two", 6, 7, 3),
        (8, "#text", "&", None, 8, 0), (9, "script", None, None, 10, 0), (10, "#hidden", "s<b>", 9, 10, 1),
        (11, "#comment", "c", None, 11, 0), (12, "i", None, None, 12, 0), (13, "#text", "z", None, 13, 0),
    ]
    assert nodes[0].classes == ["x", "y"] and nodes[0].attrs == {"id": "a", "class": "x  y"}


def test_v1_rules(pages):
    long = "x" * 160
    page = "".join([
        v1_block("r1", "A very good gym"),
        v1_block("r2", "too short"),
        v1_block("r3", "ten chars!", author=None, stars=None, date=None),
        v1_block("r4", long + " first"),
        v1_block("r5", long + " second"),
        v1_block("r6", "قبل كل شيء ممتاز", stars="٤ نجوم", date="قبل 3 يوم"),
        v1_block("r7", "Far in the past", date="9999999 years ago"),
    ])
    df = pages(page, "<p>nothing</p>", "unusual traffic" + page)
    assert rows(extract.reviews_v1(df), "page_id", "author", "rating", "text", "review_date") == [
        (0, "Ann", 5, "A very good gym", "2025-10-01"),
        (0, "Unknown", 0, "ten chars!", ""),
        (0, "Ann", 5, long + " first", "2025-10-01"),
        (0, "Ann", 5, long + " second", "2025-10-01"),
        (0, "Ann", 4, "قبل كل شيء ممتاز", "2025-10-12"),
        (0, "Ann", 5, "Far in the past", "9999999 years ago"),
    ]
    assert rows(extract.reviews_v1(df, 2), "block_no") == [(0,), (2,)]
    # the first characters decide only where a caller says so
    assert rows(extract.reviews_v1(df, opening=160), "block_no") == [(0,), (2,), (3,), (5,), (6,)]


def test_markup_in_any_case(pages):
    upper = '<DIV DATA-REVIEW-ID="r"><DIV CLASS="MyEned">An upper-case page</DIV></DIV>'
    entity = '<div class="jftiE&#102;"><span class="wiI7pd">A class with an entity</span></div>'
    df = pages(upper, entity, "<A Href='/maps/place/X'>x</A>")
    assert rows(extract.reviews_v1(df), "page_id", "text") == [(0, "An upper-case page")]
    assert rows(extract.reviews_v2(df), "page_id", "text") == [(0, "An upper-case page"), (1, "A class with an entity")]
    assert [r.href for r in extract.links(df).collect()] == ["/maps/place/X"]


def test_a_broken_page_leaves_the_others(pages):
    good = v1_block("r1", "A very good gym")
    df = pages(good, "<![foo[x]]>" + good, good)
    assert rows(extract.reviews_v1(df), "page_id") == [(0,), (2,)]
    assert [(r.page_id, r.error) for r in extract.page_errors(df).collect()] == [(1, "AssertionError")]


def test_v1_nested_block_counts_on_its_own(pages):
    inner = v1_block("in", "The inner review text", author="In")
    outer = f'<div data-review-id="out"><div class="MyEned">The outer review text</div>{inner}</div>'
    assert rows(extract.reviews_v1(pages(outer)), "author", "text") == [
        ("In", "The outer review text"), ("In", "The inner review text"),
    ]


def test_v2_layout_cascade(pages):
    def block(cls, extra=""):
        return f'<div class="{cls}" {extra}><span class="wiI7pd">Review in layout {cls}</span></div>'

    df = pages(
        block("a", 'data-review-id="1"') + block("jftiEf"), block("jftiEf") + block("hjmQqc"),
        block("hjmQqc") + block("VjjEkf"), block("VjjEkf"), block("other"),
    )
    assert rows(extract.reviews_v2(df), "page_id", "text", "review_id") == [(0, "Review in layout a", "1")] + [
        (k, f"Review in layout {name}", f"text:{sha256(f'Review in layout {name}'.encode()).hexdigest()}|author:Unknown")
        for k, name in ((1, "jftiEf"), (2, "hjmQqc"), (3, "VjjEkf"))
    ]
    short = extract.parsed_v2(df, opening=160).filter("page_id = 1")
    assert rows(short, "review_id") == [("snippet:Review in layout jftiEf|author:Unknown",)]


def test_v2_rule_steps(pages):
    body = '<span class="wiI7pd">Some text of a review</span>'
    cases = {
        '<a class="x-reviewer">Link</a><b class="d4r55">Second</b>': ("Link", 0, ""),
        '<b class="d4r55"> </b><i id="ml-reviews-page-user-review-name-7">Named</i>': ("Named", 0, ""),
        '<button aria-label="Open Profile">Prof</button>': ("Prof", 0, ""),
        '<i role="img" aria-label="no number"></i><i role="img" aria-label="4/5"></i>': ("Unknown", 4, ""),
        '<i class="kvMYJc">3</i>': ("Unknown", 3, ""),
        '<i class="fontBodyLarge fzvQIb">12 stars</i>': ("Unknown", 12, ""),
        '<i>2 weeks ago</i>': ("Unknown", 2, "2 weeks ago"),
        '<i role="img" aria-label="0 stars"></i>on <i>4</i>': ("Unknown", 0, ""),
        '<time> a week ago </time>': ("Unknown", 0, "a week ago"),
        '<i>seen 2024-05-01</i>': ("Unknown", 2, "seen 2024-05-01"),
    }
    df = pages(*(f'<div data-review-id="{i}">{head}{body}</div>' for i, head in enumerate(cases)))
    got = rows(extract.reviews_v2(df), "author", "rating", "date_raw")
    # the number scan reads a date as a rating, as the rules say: 2024 ends a word
    expected = list(cases.values())
    expected[-1] = ("Unknown", 2024, "seen 2024-05-01")
    assert got == expected


def test_v2_longest_text(pages):
    html = (
        '<div data-review-id="1"><a>a link that is the longest text of all here</a><b class="date">a date text quite long too</b>'
        "<i>first of two twins</i><i>other of the twins</i><!-- tiny --></div>"
        '<div data-review-id="1"><i>repeats the id above</i></div>'
    )
    assert rows(extract.reviews_v2(pages(html)), "text", "scraped_at") == [("first of two twins", "2025-10-15 12:00:00")]


def test_search_layout(pages):
    rated = "".join(f'<div aria-label="Rated {i % 5 + 1} stars">text {i}</div>' for i in range(12))
    plain = f'<div><b>{"y" * 51}</b></div><div>{"z" * 50}</div><div>{"a" * 60}<br></div>'
    df = pages(f'<title>Place</title><span role="link">Zoe</span>{rated}', plain, '<div aria-label="rated">x</div>')
    got = rows(extract.reviews_search(df), "page_id", "author", "rating", "text")
    assert got == [(0, "Zoe", i % 5 + 1, f"text {i}") for i in range(12)] + [(1, "Unknown", 0, "y" * 51)]
    record = extract.place_records(df, max_blocks=10, max_text=20).orderBy("page_id").first()
    assert (record.name, record.place_id, len(record.reviews), len(record.raw_html)) == ("Place", "https://h/p/0", 10, 20)


def test_place_links(pages):
    html = (
        '<a href="/url?q=https://google.com/maps/place/A&sa=U">A</a><a href="https://google.com/maps/place/A">again</a>'
        '<a href="/other">no</a><a>none</a><a href="https://google.com/maps?cid=5">B</a><a href="x/maps/place/C">C</a>'
    )
    got = extract.place_links(pages(html), 2).orderBy("link_no").select("href").collect()
    assert [r.href for r in got] == ["https://google.com/maps/place/A", "https://google.com/maps?cid=5"]


def test_ids_and_counts(pages):
    html = (
        '<div data-review-id="abc"><span aria-label="5 stars"></span></div><div class="jftiEf">short</div>'
        '<div role="article"><b class="author-name">Bo</b><i aria-label="4 stars"></i>Nice place</div>'
        '<div data-review-id="a-long-enough-id">a text of more than twenty characters</div>'
    )
    df = pages(html)
    assert rows(extract.modal_review_ids(df), "review_key") == [("Bo Nice place|4 stars|Bo",), ("a-long-enough-id",)]
    assert rows(extract.live_review_ids(df), "review_key") == [("abc",), ("short",), ("a-long-enough-id",)]
    assert [tuple(r) for r in extract.loaded_counts(df).select("blocks", "filled_blocks").collect()] == [(3, 2)]
    assert [tuple(r) for r in extract.loaded_counts(pages("<p>")).select("blocks", "filled_blocks").collect()] == [(0, 0)]


def test_a_batch_of_pages_is_parsed_in_pieces():
    batch = pa.array([f"<p>{'x' * 99}</p>" if i % 5 else None for i in range(50)])
    pieces = list(parsed_pieces(iter([batch]), piece_chars=500))
    assert len(pieces) > 5 and max(map(len, pieces)) < 10
    assert [n for p in pieces for n in p.to_pylist()] == [n for p in parsed_pieces(iter([batch])) for n in p.to_pylist()]
