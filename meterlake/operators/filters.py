"""Entry and report filters as predicates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.args import parse_date, parse_month, parse_zone
from meterlake.functions.time import instant, local_date


@dataclass(frozen=True)
class UsageFilter:
    """Local date range (both ends included) and exact project."""

    since: date | str | None = None
    until: date | str | None = None
    project: str | None = None
    tz: str = "UTC"

    def __post_init__(self) -> None:
        object.__setattr__(self, "since", parse_date(self.since))
        object.__setattr__(self, "until", parse_date(self.until))
        object.__setattr__(self, "tz", parse_zone(self.tz))

    def predicate(self) -> Column | None:
        """Conjunction of all parts, null when nothing is restricted.

        The local date is a function of ``ts``, which a Parquet scan cannot
        evaluate. No zone is a whole day away from UTC, so a plain range on
        ``ts`` that is one day wider on each side is added: it reaches the
        scan and skips row groups, and the exact test follows.
        """
        tests: list[Column] = []
        day = local_date("ts", self.tz)
        if self.since:
            tests += [F.col("ts") >= instant(_midnight(self.since, -1)), day >= F.lit(self.since)]
        if self.until:
            tests += [F.col("ts") < instant(_midnight(self.until, 2)), day <= F.lit(self.until)]
        if self.project is not None:
            tests.append(F.col("project") == self.project)
        return _all(tests)

    def apply(self, usage: DataFrame) -> DataFrame:
        predicate = self.predicate()
        return usage if predicate is None else usage.where(predicate)


@dataclass(frozen=True)
class MonthFilter:
    """Calendar month range, both ends included; any date of a month names it."""

    since: str | date | None = None
    until: str | date | None = None

    def predicate(self, day: Column) -> Column | None:
        first = F.trunc(day, "month")
        tests: list[Column] = []
        since, until = parse_month(self.since), parse_month(self.until)
        if since:
            tests.append(first >= F.lit(date(*since, 1)))
        if until:
            tests.append(first <= F.lit(date(*until, 1)))
        return _all(tests)

    def apply_months(self, monthly: DataFrame) -> DataFrame:
        return self._apply(monthly, F.to_date(F.concat(F.col("month"), F.lit("-01"))))

    def apply_weeks(self, weekly: DataFrame) -> DataFrame:
        """A week belongs to the month in which it starts."""
        return self._apply(weekly, F.col("week"))

    def _apply(self, rows: DataFrame, day: Column) -> DataFrame:
        predicate = self.predicate(day)
        return rows if predicate is None else rows.where(predicate)


def _midnight(day: date, shift_days: int) -> datetime:
    shifted = max(date.min.toordinal(), min(day.toordinal() + shift_days, date.max.toordinal()))
    return datetime.combine(date.fromordinal(shifted), time(), timezone.utc)


def _all(tests: list[Column]) -> Column | None:
    result: Column | None = None
    for test in tests:
        result = test if result is None else result & test
    return result
