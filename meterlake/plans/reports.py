"""The usage reports.

Every report is a pair of steps: ``compact`` (one pass over the entries, summed
per report key and model) and a roll-up of the priced sums. The roll-up accepts
any union of compacted inputs, so the streaming jobs use the same code.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.args import parse_weekday, parse_zone
from meterlake.functions.time import local_date, month_text, week_start
from meterlake.operators.blocks import (
    DEFAULT_HOURS, BlockRule, billing_blocks, blocks_from_meters,
)
from meterlake.operators.filters import MonthFilter, UsageFilter
from meterlake.operators.meters import DAY_BITS, compact, compact_changes, merge_meters, sorted_set, summed
from meterlake.operators.pricing import price_meters, with_cost
from meterlake.schemas import TOKENS, CostMode
from meterlake.session import stage


@dataclass(frozen=True)
class Report:
    """How a report groups entries, and how it rolls the priced groups up."""

    name: str
    keys: Callable[[], dict[str, Column | str]]
    roll_up: Callable[[DataFrame], DataFrame]
    more: Callable[[], list[Column]] = list

    def compact(self, usage: DataFrame) -> DataFrame:
        return compact(usage, *self.more(), **self.keys())

    def compact_changes(self, changes: DataFrame) -> DataFrame:
        """The same for entries that come and go, by their ``sign``."""
        if self.more():
            raise ValueError(f"{self.name} has meters from which nothing can be taken back")
        return compact_changes(changes, **self.keys())

    def run(
        self, usage: DataFrame, prices: DataFrame, mode: CostMode | str = CostMode.AUTO, strict: bool = True,
        staged: bool = False,
    ) -> DataFrame:
        """The report over ``usage``.

        By default a lazy plan, after a look-up of the prices that reads only
        the model column: next to nothing in a columnar table. Where every read
        is a full parse (raw logs), ``staged`` writes the compacted usage first
        and does the rest on that, so that ``usage`` is read once.
        """
        if staged:
            return self.from_meters(stage(self.compact(usage)), prices, mode, strict)
        return self.roll_up(price_meters(self.compact(usage), usage, prices, mode, strict))

    def from_meters(
        self, meters: DataFrame, prices: DataFrame, mode: CostMode | str = CostMode.AUTO, strict: bool = True
    ) -> DataFrame:
        """The report over stored meters (a staged or a streaming table)."""
        return self.roll_up(price_meters(meters, meters, prices, mode, strict))


def daily_report(tz: str = "UTC") -> Report:
    tz = parse_zone(tz)
    return Report(
        "daily",
        lambda: {"date": local_date("ts", tz)},
        lambda m: m.groupBy("date").agg(*summed(), sorted_set("model").alias("models_used")).orderBy("date"),
    )


def daily_by_instance_report(tz: str = "UTC") -> Report:
    tz = parse_zone(tz)
    return Report(
        "daily_by_instance",
        lambda: {"date": local_date("ts", tz), "instance_id": F.coalesce("instance_id", F.lit("default"))},
        lambda m: m.groupBy("date", "instance_id")
        .agg(*summed(), sorted_set("model").alias("models_used"))
        .orderBy("date", "instance_id"),
    )


def monthly_report(tz: str = "UTC", months: MonthFilter = MonthFilter()) -> Report:
    tz = parse_zone(tz)

    def roll_up(meters: DataFrame) -> DataFrame:
        monthly = meters.groupBy(month_text(F.col("date")).alias("month")).agg(
            *summed(), F.count_distinct("date").alias("active_days")
        )
        return months.apply_months(monthly).orderBy("month")

    return Report("monthly", lambda: {"date": local_date("ts", tz)}, roll_up)


def weekly_report(tz: str = "UTC", start_of_week: str = "sunday", months: MonthFilter = MonthFilter()) -> Report:
    tz, first = parse_zone(tz), parse_weekday(start_of_week)

    def roll_up(meters: DataFrame) -> DataFrame:
        weekly = meters.groupBy(week_start(F.col("date"), first).alias("week")).agg(
            *summed(), F.count_distinct("date").alias("active_days")
        )
        return months.apply_weeks(weekly).orderBy("week")

    return Report("weekly", lambda: {"date": local_date("ts", tz)}, roll_up)


def _by_day_bits(name: str, key: str, parts: Callable[[], tuple[Column, Column]], chosen: Callable[[DataFrame], DataFrame]) -> Report:
    """A report per period whose meters hold a bit for each day of it; ``parts`` are the period and the number of the day in it.

    Meters of any batches are added up by ``bit_or``, so days are counted exactly, and there
    is one row per period and model where daily meters have one per day.
    """

    def bits() -> list[Column]:
        return [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), parts()[1].cast("int"))).alias(DAY_BITS)]

    def roll_up(meters: DataFrame) -> DataFrame:
        days = F.bit_count(F.bit_or(DAY_BITS)).cast("bigint").alias("active_days")
        return chosen(meters.groupBy(key).agg(*summed(), days)).orderBy(key)

    return Report(name, lambda: {key: parts()[0]}, roll_up, bits)


def monthly_bits_report(tz: str = "UTC", months: MonthFilter = MonthFilter()) -> Report:
    """``monthly_report`` over meters of whole months."""
    tz = parse_zone(tz)

    def parts() -> tuple[Column, Column]:
        day = local_date("ts", tz)
        return month_text(day), F.dayofmonth(day) - 1

    return _by_day_bits("monthly_bits", "month", parts, months.apply_months)


def weekly_bits_report(tz: str = "UTC", start_of_week: str = "sunday", months: MonthFilter = MonthFilter()) -> Report:
    """``weekly_report`` over meters of whole weeks."""
    tz, first = parse_zone(tz), parse_weekday(start_of_week)

    def parts() -> tuple[Column, Column]:
        day = local_date("ts", tz)
        week = week_start(day, first)
        return week, F.datediff(day, week)

    return _by_day_bits("weekly_bits", "week", parts, months.apply_weeks)


def session_report() -> Report:
    """Per session; its model is that of the first entry by (time, position)."""
    return Report(
        "sessions",
        lambda: {"session_id": "session_id"},
        lambda m: m.groupBy("session_id")
        .agg(
            F.min("first_ts").alias("start_time"),
            F.max("last_ts").alias("end_time"),
            *summed(),
            F.min_by("model", F.struct("first_arrival", "model")).alias("model"),
        )
        .orderBy("start_time", "session_id"),
    )


@dataclass(frozen=True)
class BlockReport:
    """Billing blocks in the same two steps as the other reports."""

    as_of: str | datetime
    hours: float = DEFAULT_HOURS
    keys: tuple[str, ...] = ()
    name: str = "blocks"

    def compact(self, usage: DataFrame) -> DataFrame:
        return compact(usage, **BlockRule(self.hours, self.keys).compact_keys("session_id", "project"))

    def compact_changes(self, changes: DataFrame) -> DataFrame:
        return compact_changes(changes, **BlockRule(self.hours, self.keys).compact_keys("session_id", "project"))

    def run(
        self, usage: DataFrame, prices: DataFrame, mode: CostMode | str = CostMode.AUTO, strict: bool = True,
        staged: bool = False,
    ) -> DataFrame:
        """Blocks over ``usage``; ``staged`` as in ``Report.run`` (saves two further reads)."""
        if staged:
            return self.from_meters(stage(self.compact(usage)), prices, mode, strict)
        return billing_blocks(usage, prices, self.as_of, mode, self.hours, self.keys, strict)

    def from_meters(
        self, meters: DataFrame, prices: DataFrame, mode: CostMode | str = CostMode.AUTO, strict: bool = True
    ) -> DataFrame:
        rule = BlockRule(self.hours, self.keys)
        narrow = merge_meters(meters, *rule.compact_keys("project"))
        priced = price_meters(narrow, meters, prices, mode, strict)
        return blocks_from_meters(priced, narrow, meters, meters, rule, self.as_of)


def daily(usage: DataFrame, prices: DataFrame, mode: CostMode | str = "auto", tz: str = "UTC", strict: bool = True):
    return daily_report(tz).run(usage, prices, mode, strict)


def daily_by_instance(usage: DataFrame, prices: DataFrame, mode: CostMode | str = "auto", tz: str = "UTC", strict: bool = True):
    return daily_by_instance_report(tz).run(usage, prices, mode, strict)


def monthly(
    usage: DataFrame, prices: DataFrame, mode: CostMode | str = "auto", tz: str = "UTC",
    months: MonthFilter = MonthFilter(), strict: bool = True,
):
    return monthly_report(tz, months).run(usage, prices, mode, strict)


def weekly(
    usage: DataFrame, prices: DataFrame, mode: CostMode | str = "auto", tz: str = "UTC",
    start_of_week: str = "sunday", months: MonthFilter = MonthFilter(), strict: bool = True,
):
    return weekly_report(tz, start_of_week, months).run(usage, prices, mode, strict)


def sessions(usage: DataFrame, prices: DataFrame, mode: CostMode | str = "auto", strict: bool = True):
    return session_report().run(usage, prices, mode, strict)


def daily_detailed(usage: DataFrame, prices: DataFrame, mode: CostMode | str = "auto", tz: str = "UTC", strict: bool = True):
    """The entries behind the daily report, one row each.

    One day can hold any number of entries, so they are rows next to ``daily``
    and not an array inside it.
    """
    entries = with_cost(usage, prices, mode, strict)
    return entries.select(
        local_date("ts", parse_zone(tz)).alias("date"),
        F.col("ts").alias("timestamp"),
        "session_id",
        "model",
        *TOKENS,
        sum((F.col(name) for name in TOKENS[1:]), F.col(TOKENS[0])).alias("total_tokens"),
        F.col("cost").cast("double").alias("cost"),
        "_file",
        "_ord",
    )


def totals(report: DataFrame) -> DataFrame:
    """Grand total over the rows of any report; zeros for an empty one."""
    columns = [*TOKENS, "total_tokens"]
    return report.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in columns],
        F.coalesce(F.sum(F.col("total_cost").cast("decimal(28,14)")), F.lit(0)).cast("double").alias("total_cost"),
    )


def with_totals(report: DataFrame, key: str) -> DataFrame:
    """Report rows and their grand total (null key) in one pass."""
    return report.rollup(key).agg(
        *[F.sum(name).alias(name) for name in [*TOKENS, "total_tokens"]],
        F.sum(F.col("total_cost").cast("decimal(28,14)")).cast("double").alias("total_cost"),
    )


def primary_provider_report(
    usage: DataFrame, prices: DataFrame, kind: str, mode: CostMode | str = "auto",
    usage_filter: UsageFilter = UsageFilter(), start_of_week: str = "sunday", strict: bool = True,
) -> DataFrame:
    """Filter rules of the first provider: months and weeks see whole months and every project."""
    months = MonthFilter(usage_filter.since, usage_filter.until)
    if kind == "monthly":
        return monthly(usage, prices, mode, usage_filter.tz, months, strict)
    if kind == "weekly":
        return weekly(usage, prices, mode, usage_filter.tz, start_of_week, months, strict)
    return _filtered_report(usage, prices, kind, mode, usage_filter, start_of_week, strict)


def other_provider_report(
    usage: DataFrame, prices: DataFrame, kind: str, mode: CostMode | str = "auto",
    usage_filter: UsageFilter = UsageFilter(), start_of_week: str = "sunday", strict: bool = True,
) -> DataFrame:
    """Filter rules of the other providers: dates and project first; months are then tested again."""
    return _filtered_report(usage, prices, kind, mode, usage_filter, start_of_week, strict)


def _filtered_report(usage, prices, kind, mode, usage_filter, start_of_week, strict) -> DataFrame:
    chosen = usage_filter.apply(usage)
    tz = usage_filter.tz
    reports = {
        "daily": lambda: daily_report(tz),
        "daily_by_instance": lambda: daily_by_instance_report(tz),
        "monthly": lambda: monthly_report(tz, MonthFilter(usage_filter.since, usage_filter.until)),
        "weekly": lambda: weekly_report(tz, start_of_week),
        "sessions": session_report,
    }
    if kind == "daily_detailed":
        return daily_detailed(chosen, prices, mode, tz, strict)
    if kind not in reports:
        raise ValueError(f"Unknown report: {kind}")
    return reports[kind]().run(chosen, prices, mode, strict)
