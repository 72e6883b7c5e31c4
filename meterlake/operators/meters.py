"""The compact form of usage that all reports are built from.

A report never prices single entries. Entries are first summed per report key
and model; cost is linear in tokens, so pricing the sums gives the same cost,
and the price lookup then works on the few summed rows. The first aggregation
uses fixed-width buffers only, so it runs as a hash aggregate with map-side
combine inside whole-stage code generation, and one key that holds a third of
the input still sends a single row per map task.

Meters can be added up again: the union of two compacted inputs is a valid
compacted input. Streaming relies on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.schemas import MONEY, TOKENS

UNPRICED = [f"unpriced_{name}" for name in TOKENS]
METERS = [*TOKENS, *UNPRICED, "logged_cost", "n_entries", "n_logged", "first_ts", "last_ts", "first_arrival"]

#: Further meter of signed changes: how many entries were taken back from the group.
TAKEN_BACK = "n_taken_back"

#: Further meter of months and weeks: a bit for each of their days that has entries.
DAY_BITS = "day_bits"


def compact(usage: DataFrame, *more: Column, **keys: Column | str) -> DataFrame:
    """Sum usage per ``keys`` and model.

    ``unpriced_*`` are the tokens of entries without a logged cost. Meters that
    the report does not use are removed by the optimizer; ``more`` are meters it needs besides.
    """
    return usage.groupBy(*_groups(keys)).agg(
        *_sums(), F.count("*").alias("n_entries"), F.count("total_cost").alias("n_logged"), *_times(), *more)


def compact_changes(changes: DataFrame, **keys: Column | str) -> DataFrame:
    """``compact`` of rows with a ``sign``: +1 for an entry that came, -1 for one that is taken back.

    Times are those of all entries that came, also of those taken back later.
    """
    sign = F.col("sign")
    logged = F.when(F.col("total_cost").isNull(), 0).otherwise(sign)
    return changes.groupBy(*_groups(keys)).agg(
        *_sums(sign), F.sum(sign).alias("n_entries"), F.sum(logged).alias("n_logged"), *_times(sign),
        F.count_if(sign < 0).alias(TAKEN_BACK),
    )


def _groups(keys: dict[str, Column | str]) -> list[Column]:
    columns = [(F.col(value) if isinstance(value, str) else value).alias(name) for name, value in keys.items()]
    return columns if "model" in keys else [*columns, F.col("model")]


def _sums(sign: Column | None = None) -> list[Column]:
    def signed(value: Column) -> Column:
        return value if sign is None else F.when(sign > 0, value).otherwise(-value)

    no_cost = F.col("total_cost").isNull()
    return [
        *[F.sum(signed(F.col(name))).alias(name) for name in TOKENS],
        *[F.sum(F.when(no_cost, signed(F.col(name))).otherwise(F.lit(0))).alias(f"unpriced_{name}") for name in TOKENS],
        F.sum(signed(F.col("total_cost").cast(MONEY))).alias("logged_cost"),
    ]


def _times(sign: Column | None = None) -> list[Column]:
    def of_new(value: Column) -> Column:
        return value if sign is None else F.when(sign > 0, value)

    return [
        F.min(of_new(F.col("ts"))).alias("first_ts"),
        F.max(of_new(F.col("ts"))).alias("last_ts"),
        F.min(of_new(arrival())).alias("first_arrival"),
    ]


def merge_meters(meters: DataFrame, *keys: str) -> DataFrame:
    """Adds meters up, per model and ``keys`` (by default all keys they have)."""
    names = [*METERS, *(name for name in (TAKEN_BACK, DAY_BITS) if name in meters.columns)]
    chosen = list(keys) or [name for name in meters.columns if name not in names]
    if "model" not in chosen:
        chosen.append("model")
    smallest, largest = {"first_ts", "first_arrival"}, {"last_ts"}

    def combined(name: str) -> Column:
        if name in smallest:
            return F.min(name).alias(name)
        if name == DAY_BITS:
            return F.bit_or(name).alias(name)
        return (F.max(name) if name in largest else F.sum(name).cast(meters.schema[name].dataType)).alias(name)

    return meters.groupBy(*chosen).agg(*[combined(name) for name in names])


def arrival() -> Column:
    """Time, then position, as one fixed-width number (a hash aggregate can take its minimum)."""
    wide = "decimal(38,0)"
    return F.unix_micros("ts").cast("decimal(19,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.coalesce(
        F.col("_ord"), F.lit(0)
    ).cast(wide)


def total_tokens() -> Column:
    return sum((F.col(name) for name in TOKENS[1:]), F.col(TOKENS[0]))


def summed(cost: str = "cost") -> list[Column]:
    """Aggregates that turn priced meters into the token and cost columns of a report."""
    return [
        *[F.sum(name).alias(name) for name in TOKENS],
        F.sum(sum((F.col(name) for name in TOKENS[1:]), F.col(TOKENS[0]))).alias("total_tokens"),
        F.sum(cost).cast("double").alias("total_cost"),
    ]


def sorted_set(column: str) -> Column:
    return F.array_sort(F.collect_set(column))
