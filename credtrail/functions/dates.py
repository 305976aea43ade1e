"""Dates as they appear in commit logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what an unreadable date counts as.
ZERO_TIME = "0001-01-01T00:00:00Z"

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d+)?(Z|[+-]\d{2}:\d{2})$"


def readable_date(raw: Column) -> Column:
    """The instant of an RFC 3339 text, null if the text is not one."""
    return F.when(raw.rlike(RFC3339), F.try_to_timestamp(raw))


def instant(raw: Column) -> Column:
    """As :func:`readable_date`, with unreadable texts at the zero time."""
    return F.coalesce(readable_date(raw), F.lit(ZERO_TIME).cast("timestamp"))


def local_day(raw: Column) -> Column:
    """The day in the author's own offset; an unreadable text stays as it is."""
    return F.when(readable_date(raw).isNotNull(), F.substring(raw, 1, 10)).otherwise(raw)


def days_between(first: Column, last: Column) -> Column:
    """Whole 24-hour periods."""
    seconds = F.unix_seconds(last.cast("timestamp")) - F.unix_seconds(first.cast("timestamp"))
    return F.floor(seconds / F.lit(86400)).cast("int")


def compare_dates(left: Column, right: Column) -> Column:
    """-1, 0 or 1 by instant."""
    a, b = instant(left), instant(right)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)
