"""Calendar parts of a ``timestamp_ntz``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_start(ts: Column | str) -> Column:
    """``dt.to_period('M')`` as the first day of the month (a date)."""
    return F.trunc(_c(ts), "MM")


def month_label(ts: Column | str) -> Column:
    """``dt.strftime('%b %Y')``, e.g. ``Oct 1998``."""
    return F.date_format(_c(ts), "MMM yyyy")


def day_name(ts: Column | str) -> Column:
    """``dt.day_name()``, e.g. ``Monday``."""
    return F.date_format(_c(ts), "EEEE")


def day_index(ts: Column | str) -> Column:
    """``dt.dayofweek``: Monday = 0 ... Sunday = 6 (the weekday sort order)."""
    return F.weekday(_c(ts))


def is_weekend(ts: Column | str) -> Column:
    """``dt.dayofweek >= 5``: Saturday or Sunday."""
    return F.weekday(_c(ts)) >= 5


def hour_of_day(ts: Column | str) -> Column:
    return F.hour(_c(ts))


def in_hour_window(hour: Column | str, first: int = 19, last: int = 22) -> Column:
    """``hour.between(first, last)``, both ends inclusive."""
    return _c(hour).between(first, last)


def whole_days_between(start: Column | str, end: Column | str) -> Column:
    """``(end - start).days``: whole elapsed days, not calendar boundaries."""
    return F.timestamp_diff("DAY", _c(start), _c(end))
