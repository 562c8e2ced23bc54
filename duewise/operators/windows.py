"""Recent-versus-baseline windows measured back from the newest date of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise.functions.dates import window_label


@dataclass(frozen=True)
class WindowBounds:
    """Inclusive bounds as scalar-subquery columns."""

    baseline_start: Column
    baseline_end: Column
    recent_start: Column
    recent_end: Column

    def is_recent(self, date: str) -> Column:
        return F.col(date).between(self.recent_start, self.recent_end)

    def is_baseline(self, date: str) -> Column:
        return F.col(date).between(self.baseline_start, self.baseline_end)

    def period(self, date: str) -> Column:
        return F.when(self.is_baseline(date), F.lit("baseline")).when(self.is_recent(date), F.lit("recent"))

    def in_either(self, date: str) -> Column:
        return F.col(date).between(self.baseline_start, self.recent_end)

    @property
    def recent_label(self) -> Column:
        return window_label(self.recent_start, self.recent_end)

    @property
    def baseline_label(self) -> Column:
        return window_label(self.baseline_start, self.baseline_end)


def max_date(df: DataFrame, date: str = "stat_date") -> Column:
    """Newest date of a table as a scalar subquery."""
    return df.agg(F.max(F.to_date(date))).scalar()


def bounds_from(newest: Column, recent_days: int = 30, baseline_days: int = 30) -> WindowBounds:
    recent_start = F.date_sub(newest, recent_days - 1)
    return WindowBounds(
        baseline_start=F.date_sub(newest, recent_days + baseline_days - 1),
        baseline_end=F.date_sub(newest, recent_days),
        recent_start=recent_start,
        recent_end=newest,
    )


def window_bounds(df: DataFrame, date: str = "stat_date", recent_days: int = 30, baseline_days: int = 30) -> WindowBounds:
    return bounds_from(max_date(df, date), recent_days, baseline_days)


def last_days(df: DataFrame, days: int, date: str = "stat_date") -> DataFrame:
    """Rows of the last ``days`` days, counted back from the table's own newest date."""
    newest = max_date(df, date)
    return df.filter(F.col(date).between(F.date_sub(newest, max(int(days), 1) - 1), newest))


def latest_partition(df: DataFrame, date: str = "stat_date") -> DataFrame:
    return df.filter(F.col(date) == max_date(df, date))


def date_range(df: DataFrame, start: str | None, end: str | None, date: str = "stat_date") -> DataFrame:
    """Inclusive range with optional ends."""
    out = df
    if start:
        out = out.filter(F.col(date) >= F.to_date(F.lit(start)))
    if end:
        out = out.filter(F.col(date) <= F.to_date(F.lit(end)))
    return out


def cap_at(df: DataFrame, newest: Column, date: str = "stat_date") -> DataFrame:
    return df.filter(F.col(date) <= newest)
