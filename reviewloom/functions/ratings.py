"""Star ratings out of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.text import SPACE, strip

# Arabic-Indic digits and their ASCII forms.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"

WORD_END = r"(?![\p{L}\p{N}_])"


def ascii_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS, ASCII_DIGITS)


def to_int(digits: Column) -> Column:
    return F.nullif(ascii_digits(digits), F.lit("")).try_cast("int")


def rating_single_digit(label: Column) -> Column:
    """First lone digit that ends a word (``4.0`` reads as 4); null without one."""
    return to_int(F.regexp_extract(ascii_digits(label), rf"([0-9])(\.0)?{WORD_END}", 1))


def rating_from_label(label: Column) -> Column:
    """``n/5``, else ``Rating of n``, else the first number that ends a word."""
    text = strip(label)
    return F.coalesce(
        to_int(F.regexp_extract(text, rf"(\p{{Nd}}+)[{SPACE}]*/[{SPACE}]*5", 1)),
        to_int(F.regexp_extract(text, rf"(?iu)Rating of[{SPACE}]*(\p{{Nd}}+)", 1)),
        to_int(F.regexp_extract(ascii_digits(text), rf"(\p{{Nd}}+)(\.0)?{WORD_END}", 1)),
    )


def rating_from_stars(label: Column) -> Column:
    """``Rated n stars`` of the search layout."""
    return to_int(F.regexp_extract(label, r"Rated (\p{Nd}) stars", 1))
