"""First-wins dedup of a stream that equals the batch result, whatever arrives first.

A batch job keeps the first copy of a record by (file, position). In a stream
that copy may come last. So the state of a dedup key is the least copy seen so
far; when a lesser one arrives, the usage of the earlier one is taken back: a
row with ``sign`` -1, followed by the new copy with +1. Sums over ``sign *
tokens`` are those of the batch job after every micro-batch. Records without a key pass with +1 and have no
state; they are dealt over ``UNKEYED`` groups.

Validity is tested after dedup, as in the batch job: an invalid copy that is the first one
hides valid ones, so it is state too, but gives no rows.

Meters are compacted from the changes of a batch. Sums can be taken back; the
least and greatest times of a group cannot. ``settled_meters`` takes those from
the stored changes, for the groups from which something was taken back, which are few.

The state needs the RocksDB store (``state_conf``). A key costs a few round
trips to it in each batch it occurs in. With ``forget_after_ms`` a key is forgotten that long
after its last change; a copy that comes later then counts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meterlake.operators.meters import METERS, TAKEN_BACK, compact_changes, merge_meters
from meterlake.plans.reports import BlockReport, Report
from meterlake.schemas import USAGE, USAGE_COLUMNS
from meterlake.sources import claude
from meterlake.streaming.store import BatchStore

UNKEYED = 1024

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_FIELDS = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in USAGE)
COPIES = f"{_FIELDS}, valid boolean"
CHANGES = f"{_FIELDS}, sign int"


def state_conf(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB."""
    spark.conf.set(STATE_STORE, ROCKS_DB)


class FirstCopy(StatefulProcessor):
    """Least copy of a key by (file, position)."""

    def __init__(self, forget_after_ms: int | None = None):
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.least = handle.getValueState("least", COPIES, self.forget_after_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            for row in rows:
                if row["valid"]:
                    yield _change(row, 1)
            return
        first = min(rows, key=_place)
        old = self.least.get()
        if old is not None:
            old = Row(*USAGE_COLUMNS, "valid")(*old)
            if _place(old) <= _place(first):
                return
            if old["valid"]:
                yield _change(old, -1)
        self.least.update(tuple(first[name] for name in [*USAGE_COLUMNS, "valid"]))
        if first["valid"]:
            yield _change(first, 1)

    def close(self) -> None:
        pass


def _place(row: Row) -> tuple[str, int]:
    return row["_file"], row["_ord"]


def _change(row: Row, sign: int) -> Row:
    return Row(**{name: row[name] for name in USAGE_COLUMNS}, sign=sign)


def dedup_changes(records: DataFrame, forget_after_ms: int | None = None) -> DataFrame:
    """Usage rows with ``sign``, from a stream of records that have a position (``claude.records``)."""
    copies = claude.as_usage(records)
    spread = F.when(F.col("dedup_key").isNull(), F.pmod(F.xxhash64("_file", "_ord"), F.lit(UNKEYED)))
    grouped = copies.withColumn("_spread", spread).groupBy("dedup_key", "_spread")
    return grouped.transformWithState(
        statefulProcessor=FirstCopy(forget_after_ms), outputStructType=CHANGES, outputMode="Update",
        timeMode="ProcessingTime" if forget_after_ms else "None",
    )


def start_exact_watch(
    changes: DataFrame,
    report: Report | BlockReport,
    table: str,
    checkpoint: str,
    on_refresh: Callable[[DataFrame, int], None] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Keeps the changes and the meters of a report; ``on_refresh`` gets settled meters after each micro-batch."""

    def absorb(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored, meters = _stores(spark, table)
        stored.put(number, batch)
        if meters.last_batch < number:
            meters.put(number, report.compact_changes(stored.latest()))
        stored.tidy()
        meters.tidy()
        if on_refresh:
            on_refresh(settled_meters(spark, table, report), number)

    writer = changes.writeStream.foreachBatch(absorb).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def _stores(spark: SparkSession, table: str) -> tuple[BatchStore, BatchStore]:
    return BatchStore(spark, f"{table}/changes", netted), BatchStore(spark, f"{table}/meters", merge_meters)


def netted(changes: DataFrame) -> DataFrame:
    """Without copies that came and were taken back in these changes; at most one copy comes and goes at a place."""
    place = ["_file", "_ord"]
    came, went = changes.where("sign > 0"), changes.where("sign < 0")
    return came.join(went.select(*place), place, "left_anti").unionByName(went.join(came.select(*place), place, "left_anti"))


def exact_usage(spark: SparkSession, table: str) -> DataFrame:
    """The usage rows in force; equals the batch result over all lines read so far."""
    return netted(_stores(spark, table)[0].read()).where("sign > 0").select(*USAGE_COLUMNS)


def settled_meters(spark: SparkSession, table: str, report: Report | BlockReport) -> DataFrame:
    """Meters as ``report.compact`` of the batch result gives them, up to their order."""
    return settled(_stores(spark, table)[1].read(), exact_usage(spark, table), report)


def settled(meters: DataFrame, usage: DataFrame, report: Report | BlockReport) -> DataFrame:
    """Meters of changes, added up; ``usage`` in force gives the times of groups from which something was taken back."""
    sums = merge_meters(meters).where("n_entries > 0")
    keys = [name for name in sums.columns if name not in (*METERS, TAKEN_BACK)]
    extremes = ["first_ts", "last_ts", "first_arrival"]
    rest = [c for c in sums.columns if c not in (*extremes, TAKEN_BACK)]
    if meters.where(F.col(TAKEN_BACK) > 0).isEmpty():
        return sums.select(*rest, *extremes)  # ``usage`` need not be read
    doubtful = sums.where(F.col(TAKEN_BACK) > 0).select(*[F.col(key).alias(f"_k_{key}") for key in keys])
    of_group = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_k_{key}")) for key in keys])
    again = report.compact(usage).join(doubtful, of_group, "left_semi")
    again = again.select(*[F.col(key).alias(f"_k_{key}") for key in keys], *[F.col(e).alias(f"_{e}") for e in extremes])
    right = [F.coalesce(f"_{e}", e).alias(e) for e in extremes]
    return sums.join(again, of_group, "left").select(*rest, *right)
