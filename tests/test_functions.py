"""Golden values of the scalar expressions."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.functions import dates, ratings, replies, text, urls


def check(apply, expression, cases):
    got = apply(expression, list(cases))
    assert dict(zip(cases, got)) == cases


def test_rating_single_digit(apply):
    check(apply, ratings.rating_single_digit, {
        "5 stars": 5, "4.5 stars": 4, "4.0": 4, "4.05": 4, "10 stars": 0, "٤ نجوم": 4, "5نجوم": None, "": None, "none": None,
    })


def test_rating_from_label(apply):
    check(apply, ratings.rating_from_label, {
        "5/5": 5, "4/5": 4, "4.5/5": 5, "10/5": 10, "rating OF 3": 3, "12 stars": 12, "٤/٥": 4, " 3 / 5 ": 3, "": None,
        "99999999999": None,
    })


def test_rating_from_stars(apply):
    check(apply, ratings.rating_from_stars, {"Rated 4 stars": 4, "rated 4 stars": None, "Rated 12 stars": None})


def test_relative_date(apply):
    check(apply, lambda c: dates.relative_date(c, F.lit("2025-10-15 12:00:00").cast("timestamp")), {
        "2 weeks ago": "2025-10-01", "3 days ago on Tripadvisor": "2025-10-12", "1 month ago": "2025-09-15",
        "2 years ago": "2023-10-16", "a week ago": "a week ago", "3 hours ago": "3 hours ago",
        "January 2024": "january 2024", "Based on 3 days": "based", "قبل 3 يوم": "2025-10-12",
        "قبل ٣ يوم": "2025-10-12", "قبل 3 أشهر": "قبل 3 أشهر", "": "", "  5 DAYS ": "2025-10-10",
        "9999999 years ago": None,
    })


def test_place_id(apply):
    check(apply, urls.place_id, {
        "https://h/maps?cid=123": "123", "https://h/maps?cid=&x=1": "https://h/maps?cid=&x=1",
        "https://h/maps?cid=1&cid=2": "1", "https://h/maps": "https://h/maps", "https://h/m?x=1&cid=a%20b+c#cid=9": "a b c",
        "https://h/m?acid=4": "https://h/m?acid=4", "https://h/m?cid=%zz": "%zz", "not a url|?cid=7": "7",
    })


def test_unwrap_redirect(apply):
    check(apply, urls.unwrap_redirect, {
        "/url?q=https://h/maps/place/A&sa=U": "https://h/maps/place/A", "https://h/maps/place/B?x&y": "https://h/maps/place/B?x&y",
        "/url?q=a/url?q=b": "a",
    })


def test_keep_english(apply):
    check(apply, text.keep_english, {
        "(Translated by Google) Great gym (Original) نادي": "Great gym", "نادي رائع": "", "café clean": "caf clean",
        "A (original) B (Original) C": "A (original) B", "x (ORIGINAL) y": "x (ORIGINAL) y", "a\n\t b": "a b",
    })


def test_normalize_simple(apply):
    check(apply, text.normalize_simple, {"  A\nB \t C  d ": "a b c d", "": "", "É": "é"})
    assert apply(text.normalize_simple, [None]) == [None]


def test_blocked(apply):
    check(apply, text.is_blocked, {
        "x UNUSUAL traffic y": True, "please show you're NOT a robot": True, "recaptcha": True, "a normal page": False,
    })


def test_arabic(apply):
    check(apply, text.is_arabic, {"نادي رائع": True, "great": False, "": False, "12 ؟": False, "نادي a": True})


REPLY = ["aspect", "sentiment", "summary", "recommendation"]


def parsed(apply, reply):
    row = apply(replies.parse_reply, [reply])[0]
    return None if row is None else tuple(row[f] for f in REPLY)


def test_reply(apply):
    body = '{"aspect": "a", "sentiment": "s", "summary": "u", "recommendation": "r"}'
    whole = ("a", "s", "u", "r")
    assert parsed(apply, body) == whole
    assert parsed(apply, f"  ```json\n{body}\n```  ") == whole
    assert parsed(apply, "{}") == ("", "", "", "")
    assert parsed(apply, '{"aspect": null, "summary": "u"}') == (None, "", "u", "")
    # readers that take repeated keys keep the last value
    assert parsed(apply, '{"aspect": "a", "aspect": "b", "summary": NaN}')[:2] == ("b", "")
    for broken in (f"```\n{body}\n```", "[1]", "no json", "", f"```JSON\n{body}\n```"):
        assert parsed(apply, broken) == (
            "Parsing Error", "mixed", "Could not parse Gemini JSON. Raw response: " + broken, "Inspect raw output.",
        )
    failed = apply(lambda c: replies.parse_reply(c, F.lit("timeout")), [None])[0]
    assert tuple(failed) == ("AI Generation Error", "mixed", "Error generating summary: timeout", "Rerun pipeline.")


@pytest.mark.parametrize("fn", [text.keep_english, text.normalize_simple])
def test_cleaning_is_idempotent(apply, fn):
    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=20))
    def run(values):
        once = apply(fn, values)
        assert apply(fn, once) == once
        if fn is text.keep_english:
            assert all(v.isascii() and not re.search(r"\s\s|^\s|\s$", v) for v in once)

    run()
