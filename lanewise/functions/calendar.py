"""Columns over dates, weeks, cutoffs and transit times.

The session time zone is UTC, so a timestamp and its wall clock agree.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions.codes import col

DAY_SECONDS = 24 * 60 * 60


def as_date(value: str | date) -> date:
    return date.fromisoformat(value) if isinstance(value, str) else value


def lookback_window(run_date: str | date, days: int, end_offset: int = 1):
    """(start, end), both inclusive: end is ``end_offset`` days before the run,
    start is ``days`` days before the end."""
    end = as_date(run_date) - timedelta(days=end_offset)
    return end - timedelta(days=days), end


def within_days(c: str | Column, start: str | date, end: str | date) -> Column:
    """Inclusive day range.

    On a timestamp Catalyst unwraps the cast into a half-open range, which
    reaches the Parquet scan.
    """
    return col(c).cast("date").between(F.lit(as_date(start)), F.lit(as_date(end)))


def clock(text: Column) -> Column:
    """``HHMMSS`` to ``HH:MM:SS``."""
    return F.concat_ws(
        ":", F.left(text, F.lit(2)), F.substring(text, 3, 2), F.right(text, F.lit(2))
    )


def wrapped_clock(c: str | Column) -> Column:
    """Cutoff number ``HHMMSS``, padded; from 240000 on it wraps to the next day."""
    number = col(c)
    wrapped = F.when(number >= 240000, number - 240000).otherwise(number)
    return clock(F.lpad(wrapped.cast("string"), 6, "0"))


def plain_clock(c: str | Column) -> Column:
    """Cutoff text taken as it is, neither wrapped nor padded."""
    return clock(F.replace(col(c).cast("string"), F.lit(":"), F.lit("")))


def clock_seconds(c: str | Column) -> Column:
    """Seconds after midnight of an ``HH:MM:SS`` text."""
    parts = F.split(col(c), ":")
    hours, minutes, seconds = (parts[i].cast("int") for i in range(3))
    return hours * 3600 + minutes * 60 + seconds


def seconds_into_day(moment: str | Column, day: str | Column) -> Column:
    """Seconds from midnight of ``day`` to ``moment``, negative if it is before."""
    midnight = F.unix_date(col(day)).cast("double") * DAY_SECONDS
    return F.unix_micros(col(moment).cast("timestamp")) / F.lit(1e6) - midnight


def transit_days(
    cutoff: str | Column, release: str | Column, same_day: Column, next_day: Column
) -> Column:
    """Transit time of a package released at or before the cutoff, else the longer one.

    ``cutoff`` and ``release`` are seconds after midnight of the order day; an
    unknown release counts as missed.
    """
    return F.when(col(cutoff) >= col(release), same_day).otherwise(next_day)


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Calendar days from ``earlier`` to ``later``."""
    return F.datediff(col(later).cast("date"), col(earlier).cast("date"))


def week_monday(c: str | Column) -> Column:
    return F.date_trunc("week", col(c)).cast("date")


def week_label(c: str | Column) -> Column:
    """The day before the Monday of the week: a Sunday belongs to the Sunday before."""
    return F.date_format(F.date_sub(week_monday(c), 1), "yyyy-MM-dd")


def dow_monday0(c: str | Column) -> Column:
    return F.weekday(col(c).cast("date"))


def dow_sunday0(c: str | Column) -> Column:
    return F.dayofweek(col(c).cast("date")) - 1


def business_day(c: str | Column, hours: int = P.BUSINESS_DAY_SHIFT_HOURS) -> Column:
    """Day of a moment when the day turns ``hours`` after midnight."""
    return (col(c) - F.make_dt_interval(hours=F.lit(hours))).cast("date")


def add_days(c: Column, days: str | Column) -> Column:
    """Moment a fractional number of days after ``c``."""
    seconds = (col(days) * DAY_SECONDS).cast("decimal(18,6)")
    return c.cast("timestamp") + F.make_dt_interval(secs=seconds)


def fractional_days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY_SECONDS * 1e6)
