"""Dates in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def parse_date(text: Column | str) -> Column:
    """A date from "June 16, 2015", 2015-6-16 or 20150616, else from the first yyyy-mm-dd inside; else null (F1).

    A date that does not exist is null.
    """
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    day = lambda fmt, rx, s=t: F.when(s.rlike(rx), F.try_to_timestamp(s, F.lit(fmt)).cast("date"))
    inner = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(
        day("MMMM d, yyyy", rf"(?i)^({_MONTHS}) \d{{1,2}}, \d{{4}}$", F.initcap(t)),
        day("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
        day("yyyyMMdd", r"^\d{8}$"),
        F.when(inner != "", F.try_to_timestamp(inner, F.lit("yyyy-MM-dd")).cast("date")),
    )


def first_long_date(text: Column | str) -> Column:
    """The first "Month d, yyyy" inside a text, as a date."""
    t = F.col(text) if isinstance(text, str) else text
    return parse_date(F.regexp_extract(t, rf"((?:{_MONTHS}) \d{{1,2}}, \d{{4}})", 1))


def iso_prefix(text: Column | str) -> Column:
    """The date part of an ISO timestamp, as text (F2)."""
    return F.substring(F.col(text) if isinstance(text, str) else text, 1, 10)


def month(day: Column | str) -> Column:
    """yyyy-MM of a date."""
    return F.date_format(F.col(day) if isinstance(day, str) else day, "yyyy-MM")
