"""Active sessions of a stream, which end without new entries of their own.

A session is active while it has entries of the last minutes before "now", and
"now" of a stream is the latest entry time of the micro-batches before. The
watermark trails it by just those minutes: an entry counts while it is later
than the watermark, and what Spark drops as late does not count any more. The state of a
session is the number of its entries per moment; a timer at its oldest moment
takes that away when the watermark passes it, so counts fall and sessions end as time goes
on, whoever moves it. A session without such entries has no state.

Changed counts only are emitted, and the table keeps the latest of each session. After every
micro-batch it equals ``monitor.active_sessions`` over all entries so far, at the ``as_of`` of its rows. State holds
the moments after the watermark; before the first watermark that is the whole first micro-batch, unless ``since`` leaves older entries out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meterlake.operators.monitor import ACTIVE_MINUTES
from meterlake.streaming.store import BatchStore

COUNTS = "session_id string, entries bigint, as_of timestamp"


class RecentEntries(StatefulProcessor):
    """Entries of a session by moment (microseconds), those after the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "moments array<bigint>, counts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came: dict[int, int] = {}
        for row in rows:
            came[row["micros"]] = came.get(row["micros"], 0) + row["n"]
        yield from self._count(key, came, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._count(key, {}, timerValues)

    def _count(self, key, came: dict[int, int], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = self.recent.get()
        for moment, count in zip(*held) if held else ():
            came[moment] = came.get(moment, 0) + count
        left = {moment: count for moment, count in sorted(came.items()) if moment > watermark * 1000}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.recent.update((list(left), list(left.values())))
            self.handle.registerTimer(-(-next(iter(left)) // 1000))
        else:
            self.recent.clear()
        yield Row(session_id=key[0], entries=sum(left.values()), watermark=watermark)

    def close(self) -> None:
        pass


def active_counts(usage: DataFrame, minutes: int = ACTIVE_MINUTES, since: str | None = None) -> DataFrame:
    """``session_id, entries, as_of`` for each session whose count changes. Needs the RocksDB store (``retract.state_conf``)."""
    if since:
        usage = usage.where(F.col("ts") > F.lit(since).cast("timestamp"))
    timed = usage.select("session_id", "ts", F.unix_micros("ts").alias("micros"), F.lit(1).cast("bigint").alias("n"))
    counts = timed.withWatermark("ts", f"{minutes} minutes").groupBy("session_id").transformWithState(
        statefulProcessor=RecentEntries(), outputStructType="session_id string, entries bigint, watermark bigint",
        outputMode="Update", timeMode="EventTime",
    )
    return counts.select("session_id", "entries", F.timestamp_millis(F.col("watermark") + minutes * 60_000).alias("as_of"))


def start_active_watch(
    counts: DataFrame,
    table: str,
    checkpoint: str,
    on_refresh: Callable[[DataFrame, int], None] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Keeps the table of active sessions; ``on_refresh`` gets it after each micro-batch, those that only moved time included."""

    def absorb(batch: DataFrame, number: int) -> None:
        store = BatchStore(batch.sparkSession, table, _latest)
        store.put(number, batch.withColumn("batch", F.lit(number).cast("bigint")))
        store.tidy()
        if on_refresh:
            on_refresh(read_active(batch.sparkSession, table), number)

    writer = counts.writeStream.foreachBatch(absorb).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def read_active(spark: SparkSession, table: str) -> DataFrame:
    """``session_id, entries`` of the sessions that are active."""
    return _latest(BatchStore(spark, table).read()).where("entries > 0").select("session_id", "entries")


def _latest(rows: DataFrame) -> DataFrame:
    latest = rows.groupBy("session_id").agg(F.max_by(F.struct("entries", "as_of"), "batch").alias("_row"), F.max("batch").alias("batch"))
    return latest.select("session_id", "_row.*", "batch")
