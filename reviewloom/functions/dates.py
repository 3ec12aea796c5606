"""Relative dates against a reference-time column, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.binding import bind
from reviewloom.functions.ratings import to_int
from reviewloom.functions.text import SPACE, strip

# Days per unit, and the unit words in the order they are tried.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
ARABIC_UNITS = {"يوم": 1, "أسبوع": 7, "شهر": 30, "سنة": 365}
DATE_LIKE = (
    rf"(?iu)\p{{Nd}}+[{SPACE}]+(day|week|month|year)s?[{SPACE}]+ago"
    rf"|قبل[{SPACE}]+\p{{Nd}}+[{SPACE}]+(يوم|اسبوع|شهر|سنة)"
    r"|\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}"
    r"|\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{4}"
)


def _days_before(reference: Column, count: Column, unit_days: Column) -> Column:
    # a count too large for the calendar gives null, which callers treat as a failed row
    days = F.try_multiply(count, unit_days)
    day = F.when(days < 730_000, F.date_sub(F.to_date(reference), days))
    return F.when(F.year(day) >= 1, F.date_format(day, "yyyy-MM-dd"))


def relative_date(raw: Column, reference: Column) -> Column:
    """``2 weeks ago`` as ``yyyy-MM-dd`` before the reference; other texts come back lower-cased."""
    patterns = [(rf"(\p{{Nd}}+)[{SPACE}]+{unit}", days) for unit, days in UNIT_DAYS.items()]
    patterns += [(rf"قبل[{SPACE}]+(\p{{Nd}}+)[{SPACE}]*{unit}", days) for unit, days in ARABIC_UNITS.items()]

    def dated(text: Column) -> Column:
        tries = F.array(
            *(
                F.struct(F.regexp_extract(text, pattern, 1).alias("count"), F.lit(days).alias("unit"))
                for pattern, days in patterns
            )
        )
        first = F.get(F.filter(tries, lambda t: t["count"] != ""), F.lit(0))
        return bind(
            first,
            lambda t: F.when(t.isNull(), text).otherwise(_days_before(reference, to_int(t["count"]), t["unit"])),
        )

    text = strip(F.regexp_replace(F.lower(strip(raw)), rf"(?d)[{SPACE}]+on[{SPACE}]+.*$", ""))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit("")).otherwise(bind(text, dated))
