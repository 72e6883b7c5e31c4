"""Live figures: burn rate, projections, active sessions and spend snapshots.

"Now" is always the argument ``as_of``.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.args import parse_instant, parse_zone
from meterlake.functions.text import dollars, hours_minutes
from meterlake.functions.time import (
    HOUR_MICROS, days_in_month, hour_floor, instant, local_date, micros_between, whole_minutes, whole_seconds,
)
from meterlake.operators.meters import compact
from meterlake.operators.pricing import price_meters
from meterlake.session import stage

# Reporting thresholds (fixed values).
DEFAULT_MAX_COST = 50.0
PROJECTION_EXCEED, PROJECTION_APPROACH = 100.0, 80.0
BURN_HIGH, BURN_ELEVATED = 0.5, 0.2
BUDGET_BANDS = [(80.0, "good"), (120.0, "warn"), (150.0, "over")]
BILLING_BLOCK_HOURS = 5
ACTIVE_MINUTES = 5


def historical_max(blocks: DataFrame, user_max: float | None = None) -> DataFrame:
    """One row ``max_cost``: the user's value, else the dearest of all blocks, else the default."""
    if user_max is not None:
        return blocks.sparkSession.range(1).select(F.lit(float(user_max)).alias("max_cost"))
    dearest = F.greatest(F.coalesce(F.max("total_cost"), F.lit(0.0)), F.lit(0.0))
    return blocks.agg(dearest.alias("dearest")).select(
        F.when(F.col("dearest") > 0, F.col("dearest")).otherwise(F.lit(DEFAULT_MAX_COST)).alias("max_cost")
    )


def with_burn_rate(
    blocks: DataFrame, all_blocks: DataFrame, as_of: str | datetime, user_max: float | None = None
) -> DataFrame:
    """Adds progress, burn rate and projection to block rows.

    ``all_blocks`` are the unfiltered blocks that the historical maximum is
    taken from; it is one number, so it enters as a scalar subquery.
    """
    now = instant(parse_instant(as_of))
    elapsed = micros_between(F.col("start_time"), now)
    remaining = micros_between(now, F.col("end_time"))
    length = whole_seconds(micros_between(F.col("start_time"), F.col("end_time")))
    minutes, seconds = whole_minutes(elapsed), whole_seconds(elapsed)
    cost = F.col("total_cost")
    rate = F.when((minutes < 1) & (seconds > 0), cost / (F.greatest(seconds, F.lit(1)) / 60.0)).otherwise(
        cost / F.greatest(minutes, F.lit(1))
    )
    maximum = F.lit(float(user_max)) if user_max is not None else historical_max(all_blocks).scalar()

    def share(amount: Column) -> Column:
        return F.when(F.col("max_cost") > 0, amount / F.col("max_cost") * 100.0).otherwise(F.lit(0.0))

    return (
        blocks.withColumn("max_cost", maximum)
        .withColumn("block_progress", F.when(length > 0, seconds / length * 100.0).otherwise(F.lit(0.0)))
        .withColumn("burn_rate", rate)
        .withColumn("remaining_minutes", F.greatest(whole_minutes(remaining), F.lit(0)))
        .withColumn("projected_cost", cost + F.col("burn_rate") * F.col("remaining_minutes"))
        .withColumn("usage_percent", share(cost))
        .withColumn("projection_percent", share(F.col("projected_cost")))
        .withColumn("projection_status", projection_status(F.col("projection_percent")))
        .withColumn("burn_status", burn_status(F.col("burn_rate")))
    )


def projection_status(percent: Column) -> Column:
    return (
        F.when(percent > PROJECTION_EXCEED, F.lit("WILL EXCEED LIMIT"))
        .when(percent > PROJECTION_APPROACH, F.lit("APPROACHING LIMIT"))
        .otherwise(F.lit("WITHIN LIMITS"))
    )


def burn_status(rate: Column) -> Column:
    return (
        F.when(rate > BURN_HIGH, F.lit("HIGH")).when(rate > BURN_ELEVATED, F.lit("ELEVATED")).otherwise(F.lit("NORMAL"))
    )


def budget_band(percent: Column) -> Column:
    result = F.when(percent < 0, F.lit("muted"))
    for limit, name in BUDGET_BANDS:
        result = result.when(percent < limit, F.lit(name))
    return result.otherwise(F.lit("high"))


def block_status(is_gap: Column, is_active: Column) -> Column:
    return F.when(is_gap, F.lit("GAP")).when(is_active, F.lit("ACTIVE")).otherwise(F.lit("Complete"))


def block_time_remaining(is_active: Column, end_time: Column, as_of: str | datetime) -> Column:
    remaining = micros_between(instant(parse_instant(as_of)), end_time)
    left = F.when(whole_seconds(remaining) > 0, hours_minutes(remaining)).otherwise(F.lit("Expired"))
    return F.when(is_active, left).otherwise(F.lit("-"))


def active_sessions(usage: DataFrame, as_of: str | datetime) -> DataFrame:
    """Sessions with entries in the last five minutes, with the number of those entries."""
    cutoff = parse_instant(as_of) - timedelta(minutes=ACTIVE_MINUTES)
    recent = usage.where(F.col("ts") > instant(cutoff))
    return recent.groupBy("session_id").agg(F.count("*").alias("entries"))


def spend_snapshot(
    usage: DataFrame,
    requests: DataFrame,
    prices: DataFrame,
    as_of: str | datetime,
    monthly_fee: float,
    tz: str = "UTC",
) -> DataFrame:
    """Cost of each requested session and of the day, as share of the daily budget.

    ``requests`` has ``session_id``. ``usage`` holds the recently written
    entries (see ``sources.read_usage(..., modified_since=...)``); it is read
    once, summed per session and day, and staged.
    """
    now, zone = parse_instant(as_of), parse_zone(tz)
    today = now.astimezone(ZoneInfo(zone)).date()
    meters = stage(compact(usage, session_id="session_id", today=local_date("ts", zone) == F.lit(today)))
    priced = price_meters(meters, meters, prices)

    wanted = requests.select("session_id").distinct()
    session_cost = (
        priced.join(wanted, "session_id", "left_semi")
        .groupBy("session_id")
        .agg(F.sum("cost").cast("double").alias("session_cost"), F.min("first_ts").alias("session_start"))
    )
    day_cost = priced.where("today").agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("day_cost"))
    budget = F.lit(float(monthly_fee)) / days_in_month(F.lit(today))
    percent = F.when(budget > 0, F.col("day_cost") / budget * 100.0).otherwise(F.lit(0.0))
    left = time_left(F.col("session_start"), as_of)
    return (
        wanted.join(session_cost, "session_id", "left")
        .withColumn("session_cost", F.coalesce("session_cost", F.lit(0.0)))
        .withColumn("day_cost", day_cost.scalar())
        .withColumn("budget_percent", percent)
        .withColumn("budget_band", budget_band(F.col("budget_percent")))
        .withColumn("cost_text", F.when(F.col("session_cost") > 0, dollars(F.col("session_cost"))).otherwise(F.lit("no session")))
        .withColumn("seconds_left", whole_seconds(left))
        .withColumn("time_left", time_left_text(F.col("session_start"), as_of))
    )


def time_left(session_start: Column, as_of: str | datetime) -> Column:
    """Microseconds to the end of the five-hour block that starts at the session's hour; null if over."""
    now = instant(parse_instant(as_of))
    start = hour_floor(session_start)
    remaining = F.lit(BILLING_BLOCK_HOURS * HOUR_MICROS) - micros_between(start, now)
    return F.when((now >= start) & (whole_seconds(remaining) > 0), remaining)


def time_left_text(session_start: Column, as_of: str | datetime) -> Column:
    left = time_left(session_start, as_of)
    now = instant(parse_instant(as_of))
    minutes = whole_minutes(left)
    no_block = session_start.isNull() | (now < hour_floor(session_start))
    return (
        F.when(no_block, F.lit("no block"))
        .when(left.isNull(), F.lit("expired"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m left")))
        .otherwise(F.concat(hours_minutes(left), F.lit(" left")))
    )
