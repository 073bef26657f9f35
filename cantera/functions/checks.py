"""Validity checks on single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identifier pattern and the stored date format. One-digit months and hours
# are read too.
MBID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_PARTS = r"^(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$"


def is_mbid(value: Column) -> Column:
    return F.coalesce(value.rlike(MBID), F.lit(False))


def parse_date(value: Column) -> Column:
    """Timestamp without zone, null when the text is not a date."""
    # Every field by itself: a parse by format goes through a zone, where some times do not exist.
    part = lambda i: F.regexp_extract(value, DATE_PARTS, i)
    day = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    time = F.concat_ws(":", *[F.lpad(part(i), 2, "0") for i in (4, 5, 6)])
    return F.when(value.rlike(DATE_PARTS), F.concat_ws(" ", day, time).try_cast("timestamp_ntz"))


def format_date(value: Column) -> Column:
    return F.date_format(value, DATE_FORMAT)


def is_filled(value: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(value != "", F.lit(False))


def is_plausible_lyric(value: Column, at_least: int = 20) -> Column:
    """More than one line, or more than `at_least` characters."""
    return F.coalesce(value.contains("\n") | (F.length(value) > at_least), F.lit(False))


def fails_cast(value: Column, to: str) -> Column:
    """Present, but not of type `to`."""
    return value.isNotNull() & value.try_cast(to).isNull()
