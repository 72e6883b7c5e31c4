"""Time columns. All of them expect a session in UTC (``session.pin_utc``)."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MICROS = 3_600_000_000

# RFC 3339: date, T or blank, time, optional fraction, and a mandatory offset.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of a text in RFC 3339 form, null for anything else."""
    return F.when(text.rlike(RFC3339), F.upper(text).try_cast("timestamp"))


def local_time(ts: Column | str, tz: str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)


def local_date(ts: Column | str, tz: str = "UTC") -> Column:
    return F.to_date(local_time(ts, tz))


def week_start(day: Column, first_weekday: int) -> Column:
    """First day of the week that ``day`` is in; ``first_weekday`` counts from Sunday = 0."""
    return F.date_sub(day, (F.dayofweek(day) - 1 - first_weekday + 7) % 7)


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def hour_number(ts: Column) -> Column:
    """Whole hours since the epoch (floored, also before 1970)."""
    seconds = F.unix_seconds(ts)
    return F.call_function("div", seconds - F.pmod(seconds, F.lit(3600)), F.lit(3600))


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def instant(moment: datetime) -> Column:
    micros = (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def micros_between(earlier: Column, later: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def whole_units(micros: Column, unit_micros: int) -> Column:
    """Whole units in a span, cut off towards zero."""
    return F.call_function("div", micros, F.lit(unit_micros))


def whole_seconds(micros: Column) -> Column:
    return whole_units(micros, 1_000_000)


def whole_minutes(micros: Column) -> Column:
    return whole_units(micros, 60_000_000)


@lru_cache(maxsize=None)
def _abbreviations(tz: str) -> dict[int, str]:
    """UTC offset in seconds -> zone abbreviation, newest use of an offset first."""
    zone = ZoneInfo(tz)
    found: dict[int, str] = {}
    day = datetime(2037, 12, 15, tzinfo=timezone.utc)
    while day.year >= 1970:
        there = day.astimezone(zone)
        found.setdefault(int(there.utcoffset().total_seconds()), there.tzname())
        day -= timedelta(days=14)
    return found


def zone_label(ts: Column, tz: str) -> Column:
    """Abbreviation of the zone at that moment (``EST``, ``EDT``, ``UTC``)."""
    names = _abbreviations(tz)
    offset = F.unix_seconds(local_time(ts, tz)) - F.unix_seconds(ts)
    label = F.lit(tz)
    for seconds, name in names.items():
        label = F.when(offset == seconds, F.lit(name)).otherwise(label)
    return label
