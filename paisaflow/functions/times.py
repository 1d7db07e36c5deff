"""Time expressions on ``timestamp_ntz`` columns; none depends on the session time zone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from paisaflow.schemas import HOLIDAYS


def seconds_between(start: Column, end: Column) -> Column:
    """Signed ``end - start`` in seconds with microseconds kept, as a double."""
    return (end - start).cast("interval second").cast("decimal(24,6)").cast("double")


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(seconds_between(a, b)) / F.lit(3600.0)


def epoch_seconds(ts: Column) -> Column:
    return seconds_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def plus_days(ts: Column, days: Column) -> Column:
    """``ts`` moved by a possibly fractional number of days, to the microsecond."""
    seconds = F.round(days.cast("double") * F.lit(86400.0), 6).cast("decimal(18,6)")
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def parse_naive(text: Column) -> Column:
    """ISO text to wall-clock time; an offset is dropped, not applied."""
    return text.try_cast("timestamp_ntz")


def parse_export_timestamp(text: Column) -> Column:
    """The first of the accepted export formats that fits, else null."""
    day_first = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}:\d{1,2}:\d{1,2}))?$"
    t = F.trim(F.regexp_replace(F.trim(text), day_first, "$3-$2-$1 $4"))
    # try_cast also takes bare years and months, which the exports do not use
    return F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), t.try_cast("timestamp_ntz"))


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def is_weekend_or_holiday(ts: Column, holidays: Iterable[str] = HOLIDAYS) -> Column:
    """``holidays``: days off of the years in the data, as ``yyyy-mm-dd``."""
    day = F.to_date(ts)
    return is_weekend(day) | day.isin([F.lit(h).cast("date") for h in holidays])
