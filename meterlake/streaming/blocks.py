"""Billing blocks kept up to date: a micro-batch recomputes the blocks it changes, and no others.

A late entry can open a block, move the starts of the blocks behind it, or join two of
them; an entry that is taken back can undo that. Block starts follow from the
distinct units of a timeline (``operators/blocks.py``), two an hour at most. So a micro-batch

1. adds its meters and unit counts to their tables,
2. folds the units of the touched timelines with and without its own, and compares:
   a block is affected if a unit of it was touched, has come or has gone,
3. rolls up the affected blocks from the meters of their units; as a block never
   depends on the blocks behind it, folding whole blocks alone gives the same blocks,
4. writes them, and a mark for each block that is no more.

The block table keeps the latest row of each block. The dearest block (the base of
usage shares) is a maximum that can fall, so it is kept per day of block starts; a micro-batch
computes the days of its affected blocks again.

Gaps and activity depend on neighbours and on the time asked for, so they are added to the few
block rows when they are read. Costs are those of the prices the watch was started with. Blocks
below an hour need no fold and are left to ``live.start_watch``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlake.operators.blocks import (
    BlockRule, assign_blocks, fold_units, roll_up_blocks, with_activity, with_gap_rows, with_session_count,
)
from meterlake.operators.meters import merge_meters
from meterlake.operators.monitor import DEFAULT_MAX_COST
from meterlake.operators.pricing import price_meters
from meterlake.plans.reports import BlockReport
from meterlake.session import stage
from meterlake.streaming.retract import exact_usage, netted, settled
from meterlake.streaming.store import BatchStore


class BlockWatch:
    """The tables behind the blocks of a report; ``absorb`` takes in a micro-batch of changes (usage with ``sign``)."""

    def __init__(self, spark: SparkSession, table: str, report: BlockReport, prices: DataFrame):
        self.spark, self.table, self.report, self.prices = spark, table, report, prices
        self.rule = BlockRule(report.hours, report.keys)
        if self.rule.below_an_hour:
            raise ValueError("blocks below an hour are watched with live.start_watch")
        self.keys = list(self.rule.keys)
        by_unit = [*self.keys, "_unit"]
        self.changes = BatchStore(spark, f"{table}/changes", netted)
        # sorted by unit, so that row groups of other times are skipped
        self.meters = BatchStore(spark, f"{table}/meters", lambda df: merge_meters(df).sortWithinPartitions("_unit"))
        self.units = BatchStore(spark, f"{table}/units", lambda df: df.groupBy(*by_unit).agg(F.sum("n").alias("n")))
        self.blocks = BatchStore(spark, f"{table}/blocks", lambda df: self._latest(df).sortWithinPartitions("_start_hour"))
        self.days = BatchStore(spark, f"{table}/days", _latest_days)

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Each table takes the batch once; what a crash left out is done by the replay."""
        self.changes.put(number, batch)
        if self.meters.last_batch < number:
            self.meters.put(number, self.report.compact_changes(self.changes.latest()))
        if self.units.last_batch < number:
            by_unit = self.meters.latest().groupBy(*self.keys, "_unit")
            self.units.put(number, by_unit.agg(F.sum("n_entries").alias("n")))
        if self.blocks.last_batch < number:
            self.blocks.put(number, self._changed_blocks(number))
        if self.days.last_batch < number:
            self.days.put(number, self._changed_days(number))
        for store in (self.changes, self.meters, self.units, self.blocks, self.days):
            store.tidy()

    def _changed_blocks(self, number: int) -> DataFrame:
        own = self.units.latest()
        timelines = own.select(*self.keys).distinct()
        counts = self.units.read()
        if self.keys:
            counts = self._semi(counts, timelines, self.keys)
        touched = own.select(*self.keys, "_unit", F.col("n").alias("_own"), F.lit(0).cast("bigint").alias("n"))
        known = counts.select(*self.keys, "_unit", F.lit(None).cast("bigint").alias("_own"), "n").unionByName(touched)
        units = stage(known.groupBy(*self.keys, "_unit").agg(F.sum("n").alias("n"), F.sum("_own").alias("_own")))

        before = fold_units(units.where("n - coalesce(_own, 0) > 0"), self.rule)
        after = stage(fold_units(units.where("n > 0"), self.rule))
        nothing = F.lit(None).cast("bigint")

        def side(rows: DataFrame, old: Column, new: Column, hit: bool) -> DataFrame:
            return rows.select(*self.keys, "_unit", old.alias("_old"), new.alias("_new"), F.lit(hit).alias("_hit"))

        start = F.col("_start_hour")
        sides = [side(before, start, nothing, False), side(after, nothing, start, False), side(own, nothing, nothing, True)]
        per_unit = reduce(DataFrame.unionByName, sides).groupBy(*self.keys, "_unit").agg(
            F.max("_old").alias("_old"), F.max("_new").alias("_new"), F.max("_hit").alias("_hit"))
        changed = per_unit.where(F.col("_hit") | ~F.col("_old").eqNullSafe(F.col("_new")))
        affected = changed.select(*self.keys, F.explode(F.array("_old", "_new")).alias("_start_hour")).where("_start_hour IS NOT NULL")
        affected = stage(affected.distinct())

        block = [*self.keys, "_start_hour"]
        wanted = stage(self._semi(after, affected, block).select(*self.keys, "_unit"))
        low, high = wanted.agg(F.min("_unit"), F.max("_unit")).first()
        near = self.meters.read().where(F.col("_unit").between(low if low is not None else 0, high if high is not None else -1))
        sums = settled(self._semi(near, wanted, [*self.keys, "_unit"]), exact_usage(self.spark, self.table), self.report)
        narrow = merge_meters(sums, *self.rule.compact_keys("project"))
        priced = price_meters(narrow, sums, self.prices)
        rows = roll_up_blocks(assign_blocks(priced, wanted, self.rule), self.rule)
        rows = with_session_count(rows, sums, wanted, self.rule)
        over = self._semi(affected, after, block, "left_anti")
        return (
            rows.withColumn("alive", F.lit(True))
            .unionByName(over.withColumn("alive", F.lit(False)), allowMissingColumns=True)
            .withColumn("batch", F.lit(number).cast("bigint"))
        )

    def _changed_days(self, number: int) -> DataFrame:
        """Dearest block of each day in which a block has changed; null if none is left."""
        day = F.floor(F.col("_start_hour") / 24).alias("day")
        days = self.blocks.latest().select(day).distinct()
        bounds = days.agg(F.min("day"), F.max("day")).first()
        first, last = (bounds[0] or 0) * 24, (bounds[1] if bounds[1] is not None else -1) * 24 + 23
        alive = self._latest(self.blocks.read().where(F.col("_start_hour").between(first, last))).where("alive")
        dearest = alive.groupBy(day).agg(F.max("total_cost").alias("max_cost"))
        return days.join(dearest, "day", "left").withColumn("batch", F.lit(number).cast("bigint"))

    def current(self, as_of: str | datetime | None = None) -> DataFrame:
        """All blocks and gaps, as ``billing_blocks`` gives them."""
        alive = self._latest(self.blocks.read()).where("alive").drop("alive", "batch")
        return with_gap_rows(with_activity(alive, self.rule, as_of or self.report.as_of), self.rule)

    def historical_max(self) -> DataFrame:
        """``max_cost`` as ``monitor.historical_max`` gives it, from a row per day."""
        dearest = _latest_days(self.days.read()).agg(F.max("max_cost").alias("dearest"))
        return dearest.select(F.when(F.col("dearest") > 0, F.col("dearest")).otherwise(F.lit(DEFAULT_MAX_COST)).alias("max_cost"))

    def _latest(self, rows: DataFrame) -> DataFrame:
        block = [*self.keys, "_start_hour"]
        rest = [c for c in rows.columns if c not in block]
        return rows.groupBy(*block).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*block, "_row.*")

    @staticmethod
    def _semi(rows: DataFrame, chosen: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
        """Rows with (or without) a partner; nulls are equal."""
        other = chosen.select(*[F.col(c).alias(f"_s_{c}") for c in columns])
        return rows.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in columns]), how)


def _latest_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day").agg(F.max_by("max_cost", "batch").alias("max_cost"), F.max("batch").alias("batch"))


def start_block_watch(
    changes: DataFrame,
    report: BlockReport,
    prices: DataFrame,
    table: str,
    checkpoint: str,
    on_refresh: Callable[[BlockWatch, int], None] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Keeps the blocks of a stream of changes (``retract.dedup_changes``, or usage with ``sign`` 1)."""

    def absorb(batch: DataFrame, number: int) -> None:
        watch = BlockWatch(batch.sparkSession, table, report, prices)
        watch.absorb(batch, number)
        if on_refresh:
            on_refresh(watch, number)

    writer = changes.writeStream.foreachBatch(absorb).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
