"""Local days, nights and window bounds.

Instants are Spark TIMESTAMPs.  A local day is the calendar day of an instant
in a named zone; the expressions below do not depend on the session time zone.
Window bounds are literals computed while the plan is built, so a filter on
``started_at`` reaches the parquet scan.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

from ..schema import BACKFILL_CHUNK_DAYS, BACKFILL_EPOCH, DEFAULT_TZ

DAY_MICROS = 86_400_000_000
NIGHT_SHIFT_HOURS = 6  # a segment that starts before 06:00 belongs to the night before


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(value: dt.date | str) -> dt.date:
    """A date from a date or a YYYY-MM-DD string; anything else is an error."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.strptime(value, "%Y-%m-%d").date()
    except (TypeError, ValueError):
        raise ValueError(f"dates must be YYYY-MM-DD, got {value!r}") from None


def days_before(day, days: int) -> dt.date:
    return as_date(day) - dt.timedelta(days=days)


def check_range(start, end) -> tuple[dt.date, dt.date]:
    """A validated closed date range, of any length."""
    a, b = as_date(start), as_date(end)
    if a > b:
        raise ValueError(f"start {a} is after end {b}")
    return a, b


def positive(value, name: str) -> int:
    """An integer argument of at least one; anything else is an error, never a guess."""
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a whole number, got {value!r}") from None
    if number < 1:
        raise ValueError(f"{name} must be at least 1, got {number}")
    return number


def day_start(day: dt.date, tz: str = DEFAULT_TZ) -> dt.datetime:
    """The instant at which a local day begins (plan-building helper)."""
    return dt.datetime.combine(as_date(day), dt.time(), ZoneInfo(tz)).astimezone(dt.timezone.utc)


def local_micros(ts: Column | str, tz: str = DEFAULT_TZ) -> Column:
    """Wall-clock time of an instant in `tz`, as microseconds since 1970-01-01 00:00 there."""
    return F.unix_micros(F.from_utc_timestamp(as_col(ts), tz))


def _day_of(micros: Column) -> Column:
    return F.date_from_unix_date(F.floor(micros / DAY_MICROS).cast("int"))


def local_day(ts: Column | str, tz: str = DEFAULT_TZ) -> Column:
    return _day_of(local_micros(ts, tz))


def local_minute(ts: Column | str, tz: str = DEFAULT_TZ) -> Column:
    """Minute of the local day, 0 to 1439."""
    return F.pmod(F.floor(local_micros(ts, tz) / 60_000_000), F.lit(1440))


def night_date(ts: Column | str, tz: str = DEFAULT_TZ) -> Column:
    """The night an instant belongs to: its local day after stepping back six hours."""
    return _day_of(local_micros(ts, tz) - NIGHT_SHIFT_HOURS * 3_600_000_000)


def utc_time(ts: Column | str) -> Column:
    """An instant's UTC wall-clock time, as TIMESTAMP_NTZ."""
    return F.to_utc_timestamp(as_col(ts), F.current_timezone()).cast("timestamp_ntz")


def local_midnight(day: Column | str, tz: str = DEFAULT_TZ) -> Column:
    """The instant at which a DATE column's local day begins.

    A day that starts inside a spring-forward gap begins at the gap's end.
    """
    wall = as_col(day).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(tz), F.current_timezone(), wall).cast("timestamp")


def next_local_midnight(day: Column | str, tz: str = DEFAULT_TZ) -> Column:
    return local_midnight(F.date_add(as_col(day), 1), tz)


def in_days(ts: Column | str, start, end, tz: str = DEFAULT_TZ) -> Column:
    """`ts` lies in the closed range of local days [start, end]; a pushable range filter."""
    c = as_col(ts)
    lo = F.lit(day_start(start, tz))
    hi = F.lit(day_start(as_date(end) + dt.timedelta(days=1), tz))
    return (c >= lo) & (c < hi)


def before_day(ts: Column | str, day, tz: str = DEFAULT_TZ) -> Column:
    return as_col(ts) < F.lit(day_start(day, tz))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return (F.unix_micros(as_col(end)) - F.unix_micros(as_col(start))) / F.lit(60_000_000.0)


def backfill_chunk(ts: Column | str, tz: str = "UTC") -> Column:
    """Ordinal of the 90-day history chunk an instant falls in."""
    days = F.datediff(local_day(ts, tz), F.lit(BACKFILL_EPOCH).cast("date"))
    return F.floor(days / F.lit(BACKFILL_CHUNK_DAYS)).cast("bigint")
