"""Date and time expressions. All of them are independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duewise.functions.rates import col


def as_date(value: Column | str) -> Column:
    return F.to_date(col(value))


def parse_date(value: Column | str) -> Column:
    """Text to date; text that is not a date becomes null."""
    return F.try_to_timestamp(col(value)).cast("date")


def seconds_of_day(value: Column | str) -> Column:
    c = col(value)
    return F.hour(c) * 3600.0 + F.minute(c) * 60.0 + F.extract(F.lit("SECOND"), c).cast("double")


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    a, b = col(later), col(earlier)
    days = F.datediff(F.to_date(a), F.to_date(b))
    return days * 24.0 + (seconds_of_day(a) - seconds_of_day(b)) / 3600.0


def day_ceiling(value: Column | str) -> Column:
    """First midnight at or after a timestamp, as a date.

    ``ts <= midnight of D`` is the same as ``day_ceiling(ts) <= D``, so payments can be summed per day
    before they meet the due date.
    """
    c = col(value)
    return F.when(seconds_of_day(c) > 0, F.date_add(F.to_date(c), 1)).otherwise(F.to_date(c))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days, never negative; 0.0 when either side is missing."""
    diff = F.datediff(as_date(later), as_date(earlier)).cast("double")
    return F.coalesce(F.when(diff < 0, F.lit(0.0)).otherwise(diff), F.lit(0.0))


def months_on_book(later: Column | str, earlier: Column | str) -> Column:
    return F.greatest(F.floor(F.datediff(as_date(later), as_date(earlier)) / 30), F.lit(0)).cast("int")


def window_label(start: Column | str, end: Column | str) -> Column:
    """``2001-07-03~2001-08-01``."""
    return F.concat_ws("~", F.date_format(col(start), "yyyy-MM-dd"), F.date_format(col(end), "yyyy-MM-dd"))
