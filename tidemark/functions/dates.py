"""Dates and calendar keys; none depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _day(value: Column | str) -> Column:
    # Month and day may have one or two digits; anything else gives null.
    return F.try_to_date(value, "M/d/yyyy")


def date_to_epoch(value: Column | str) -> Column:
    """Seconds since 1970 (UTC) of a ``month/day/year`` string; null if it is not one."""
    return F.unix_date(_day(value)).cast("bigint") * 86400


def date_to_timestamp(value: Column | str) -> Column:
    """Midnight of the day, without a zone."""
    return _day(value).cast("timestamp_ntz")


def date_year(value: Column | str) -> Column:
    """The third part of a ``month/day/year`` string, as text."""
    return F.try_element_at(F.split(value, "/"), F.lit(3))


def year_week(ts: Column | str) -> Column:
    """Calendar year followed by the ISO week, without padding.

    The two are of different calendars: 1 January and 31 December 2018 are both ``20181``.
    """
    return F.concat(F.year(ts).cast("string"), F.weekofyear(ts).cast("string"))
