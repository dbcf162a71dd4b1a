"""Dates, hours and minutes out of epoch milliseconds and text timestamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(ms) -> Column:
    """``yyyy-MM-dd`` of an epoch-millisecond column, in the session time zone."""
    return F.timestamp_millis(ms).cast("date").cast("string")


def hour_of(ms) -> Column:
    """Two-digit hour of an epoch-millisecond column, in the session time zone."""
    return F.lpad(F.hour(F.timestamp_millis(ms)).cast("string"), 2, "0")


def with_log_time(logs):
    """Add ``logDate`` and ``logHour`` to log records."""
    return logs.withColumns({"logDate": day_of("ts"), "logHour": hour_of("ts")})


def text_day(text: Column) -> Column:
    """The part of a ``yyyy-MM-dd HH:mm:ss`` text before the space."""
    return F.substring_index(text, " ", 1)


def text_hour(text: Column) -> Column:
    """The hour of a ``yyyy-MM-dd HH:mm:ss`` text in two digits, also where one is
    written; NULL when there is no hour from 0 to 23."""
    hour = F.regexp_extract(text, r"^\S+ ([01]?[0-9]|2[0-3])(:|$| )", 1)
    return F.when(hour != "", F.lpad(hour, 2, "0"))


def is_sane(ms) -> Column:
    """Whether a time in epoch milliseconds is within the years 1970 to 9999."""
    return F.col(ms).between(0, 253_402_300_799_999)


def minute_of(ms) -> Column:
    """Whole minutes since the epoch."""
    return F.call_function("div", F.col(ms) if isinstance(ms, str) else ms, F.lit(60000))


def previous_day(day: str) -> Column:
    return F.date_sub(F.to_date(F.lit(day)), 1).cast("string")
