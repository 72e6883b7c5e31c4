"""Amp logs: one JSON object per thread file, with messages and a usage ledger.

Threads are small and many. Files ``T-*.jsonl`` hold any number of them, one per line, and are
read as splittable text beside the single ones.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.time import parse_rfc3339
from meterlake.schemas import USAGE_COLUMNS
from meterlake.sources.lines import all_counts, count_of, json_rows, read_documents, read_lines

# Wire fields (fixed values of the log format).
RECORD = """
    id string,
    messages array<struct<id: string, usage: struct<cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint>>>,
    usageLedger struct<events: array<struct<
        messageId: string, model: string, inputTokens: bigint, outputTokens: bigint, credits: double, createdAt: string>>>
"""


def read(spark: SparkSession, paths: str | list[str], modified_since: datetime | None = None) -> DataFrame:
    bundles = read_lines(spark, paths, "T-*.jsonl", modified_since=modified_since)
    bundled = bundles.select("value", F.concat("_file", F.lit("#"), F.col("_ord").cast("string")).alias("_file"))
    return parse(read_documents(spark, paths, "T-*.json", modified_since).unionByName(bundled))


def parse(documents: DataFrame) -> DataFrame:
    """Usage rows from ``value, _file``: one per ledger event, cache tokens from its message.

    The lookup stays inside the thread's row, so it needs no shuffle. The last
    message with that id and with usage counts wins: the first hit in the
    reversed list.
    """
    threads = json_rows(documents, RECORD, "_file").where(F.col("id").isNotNull())
    messages = F.coalesce("messages", F.array().cast(threads.schema["messages"].dataType))
    ledger = F.col("usageLedger.events")
    well_formed = F.forall(messages, lambda m: m.isNotNull() & m["id"].isNotNull() & all_counts(
        m["usage"]["cache_creation_input_tokens"], m["usage"]["cache_read_input_tokens"]
    )) & F.forall(ledger, lambda e: e.isNotNull() & all_counts(e["inputTokens"], e["outputTokens"]))
    counted = F.reverse(F.filter(messages, lambda m: m["usage"].isNotNull()))
    events = (
        threads.where(ledger.isNotNull() & well_formed)
        .withColumn("_counted", counted)
        .withColumn("_ids", F.transform("_counted", lambda m: m["id"]))
        .select("id", "_file", "_counted", "_ids", F.posexplode(ledger).alias("_ord", "_event"))
        .withColumn("_place", F.array_position("_ids", F.col("_event.messageId")))
        .withColumn("_usage", F.get("_counted", (F.col("_place") - 1).cast("int"))["usage"])
        .withColumn("ts", parse_rfc3339(F.col("_event.createdAt")))
    )
    spent = (count_of(F.col("_event.inputTokens")) > 0) | (count_of(F.col("_event.outputTokens")) > 0)
    return events.where(spent & F.col("ts").isNotNull()).select(
        F.lit("amp").alias("provider"),
        F.col("id").alias("session_id"),
        "ts",
        F.coalesce("_event.model", F.lit("unknown")).alias("model"),
        count_of(F.col("_event.inputTokens")).alias("input_tokens"),
        count_of(F.col("_event.outputTokens")).alias("output_tokens"),
        count_of(F.col("_usage.cache_creation_input_tokens")).alias("cache_creation_tokens"),
        count_of(F.col("_usage.cache_read_input_tokens")).alias("cache_read_tokens"),
        F.col("_event.credits").alias("total_cost"),
        F.lit(None).cast("string").alias("project"),
        F.lit(None).cast("string").alias("instance_id"),
        "_file",
        F.col("_ord").cast("bigint").alias("_ord"),
    ).select(*USAGE_COLUMNS)
