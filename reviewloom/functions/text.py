"""Cleaning, normalising and testing review text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space (Unicode), as a regex class body.
SPACE = r"\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The same as a plain string.
SPACE_CHARACTERS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Phrases of an anti-robot page.
BLOCKED_PHRASES = (
    "unusual traffic",
    "Our systems have detected unusual traffic",
    "To continue, please",
    "help us confirm",
    "Please show you're not a robot",
    "Recaptcha",
)

# Markers written around translated text.
ORIGINAL_MARKERS = ("(Original)", "(original)")
TRANSLATED_NOTE = r"(?iu)\(Translated by Google\)"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind, not only blanks."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def or_default(value: Column, default: Column) -> Column:
    """The default replaces null and the empty string, but not blanks."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def normalize_simple(text: Column) -> Column:
    """One-line, lower-case form of a review; null stays null."""
    return F.lower(collapse(text))


def keep_english(text: Column) -> Column:
    """The ASCII part of a review, up to the marker that introduces the original wording."""
    first, second = (F.substring_index(text, marker, 1) for marker in ORIGINAL_MARKERS)
    head = (
        F.when(F.contains(text, F.lit(ORIGINAL_MARKERS[0])), first)
        .when(F.contains(text, F.lit(ORIGINAL_MARKERS[1])), second)
        .otherwise(text)
    )
    ascii_only = F.regexp_replace(F.regexp_replace(head, TRANSLATED_NOTE, " "), r"[^\x00-\x7F]+", " ")
    return collapse(ascii_only)


def is_blocked(html: Column) -> Column:
    """Does the page look like an anti-robot page?"""
    lowered = F.lower(html)
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(p.lower())) for p in BLOCKED_PHRASES))


def snippet(text: Column, length: int = 160) -> Column:
    return F.substring(text, 1, length)


def arabic_share(text: Column) -> Column:
    """Share of Arabic-script letters among all letters; null when there is no letter."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    arabic = F.length(F.regexp_replace(text, r"[^\x{0620}-\x{064A}\x{066E}-\x{06D3}]+", ""))
    return arabic / F.nullif(letters, F.lit(0))


def is_arabic(text: Column, threshold: float = 0.5) -> Column:
    """Script test standing in for a language detector whose only used answer is Arabic."""
    return F.coalesce(arabic_share(text) >= threshold, F.lit(False))


def text_key(text: Column) -> Column:
    """Short join key for long texts; null has a key of its own so that it can match."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))
