"""Continuously updated reports.

The batch reports work on compacted meters that can be added up. A streaming
job therefore only compacts the *new* entries of each micro-batch and appends
them to a meter table; a refresh rolls that small table up with the batch code.
Every report, also those that no single streaming aggregation can express
(active days, billing blocks), is exact for all lines read so far, and a late
line simply counts in the next refresh.

Each micro-batch is committed to the meter table once, by its batch id, so a
restarted query or a lost executor neither loses nor repeats entries. The table
merges its folders as they get many (``streaming/store.py``).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlake.functions.time import parse_rfc3339
from meterlake.operators.meters import compact, merge_meters
from meterlake.plans.reports import BlockReport, Report
from meterlake.sources import claude
from meterlake.streaming.store import BatchStore


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New log files below ``path`` as lines.

    The file source reads each file once: logs must be moved in when complete,
    or be rotated. Lines appended to a file that has been read are not seen.
    A stream cannot number lines, so ``_ord`` is null; ``start_watch`` fills it.
    """
    reader = (
        spark.readStream.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.lit(None).cast("bigint").alias("_ord"),
    )


def stream_usage(spark: SparkSession, path: str, watermark: str | None = None, **options) -> DataFrame:
    """Valid, de-duplicated usage from a folder of log files."""
    return claude.valid_usage(dedup_stream(claude.records(stream_lines(spark, path, **options)), watermark))


def dedup_stream(records: DataFrame, watermark: str | None = None) -> DataFrame:
    """One copy of every dedup key; records without a key all stay.

    The copy that arrives first is kept, which need not be the first by file
    name that the batch job keeps; copies that differ in more than their place
    can therefore give other sums. Without ``watermark`` (for example ``"7
    days"``) all keys are remembered. With it, a key is forgotten once the
    watermark has passed it, state stays bounded, and records later than the
    watermark are dropped.
    """
    keyed = records.withColumn("_unkeyed", F.when(F.col("dedup_key").isNull(), F.expr("uuid()")))
    keys = ["dedup_key", "_unkeyed"]
    if watermark is None:
        return keyed.dropDuplicates(keys).drop("_unkeyed")
    event_time = F.coalesce(parse_rfc3339(F.col("timestamp")), F.timestamp_micros(F.lit(0)))
    timed = keyed.withColumn("_event_time", event_time).withWatermark("_event_time", watermark)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_unkeyed", "_event_time")


def start_watch(
    usage: DataFrame,
    report: Report | BlockReport,
    table: str,
    checkpoint: str,
    on_refresh: Callable[[DataFrame, int], None] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Keeps the meter table of a report up to date.

    ``on_refresh(meters, batch_id)`` is called after each micro-batch with the
    whole table, typically to write ``report.from_meters(meters, prices)``.
    ``every`` is a processing-time interval such as ``"5 seconds"``; without it
    the query handles all files that are present and stops.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        # entries of one file must differ in their position
        numbered = batch.withColumn("_ord", F.coalesce("_ord", F.monotonically_increasing_id()))
        store = BatchStore(batch.sparkSession, table, merge_meters)
        store.put(batch_id, report.compact(numbered))
        store.tidy()
        if on_refresh:
            on_refresh(read_meters(batch.sparkSession, table), batch_id)

    writer = usage.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def read_meters(spark: SparkSession, table: str) -> DataFrame:
    """All meters so far; there are none to read before the first micro-batch."""
    return BatchStore(spark, table).read()


def running_sums(usage: DataFrame, **keys) -> DataFrame:
    """Token sums per key and model as a stateful streaming aggregation.

    For dashboards that want changed rows only (``update`` mode) and need no
    price lookup; the state holds one row per key and model.
    """
    return compact(usage, **keys).drop("first_arrival")
