"""Display text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.functions.time import local_time, whole_minutes, whole_seconds, zone_label


def grouped(number: Column) -> Column:
    """1234567 -> ``1,234,567``."""
    return F.format_number(number, 0)


def dollars(amount: Column) -> Column:
    return F.format_string("$%.2f", amount)


def duration(micros: Column) -> Column:
    """``0m`` up to zero seconds, ``Xm`` below one hour, else ``Xh Ym``."""
    minutes = whole_minutes(micros)
    return (
        F.when(whole_seconds(micros) <= 0, F.lit("0m"))
        .when(minutes < 60, F.format_string("%dm", minutes))
        .otherwise(hours_minutes(micros))
    )


def hours_minutes(micros: Column) -> Column:
    minutes = whole_minutes(micros)
    return F.format_string("%dh %dm", F.call_function("div", minutes, F.lit(60)), minutes % 60)


def local_minute(ts: Column, tz: str) -> Column:
    """``yyyy-MM-dd HH:mm ZONE`` in the given zone."""
    return F.concat_ws(" ", F.date_format(local_time(ts, tz), "yyyy-MM-dd HH:mm"), zone_label(ts, tz))


def rfc3339(ts: Column) -> Column:
    """UTC time with the fraction left out when it is zero."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = (
        F.when(micros == 0, F.lit(""))
        .when(micros % 1000 == 0, F.format_string(".%03d", F.call_function("div", micros, F.lit(1000))))
        .otherwise(F.format_string(".%06d", micros))
    )
    return F.concat(base, fraction, F.lit("+00:00"))
