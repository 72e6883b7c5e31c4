"""Claude logs: JSON lines, one record per line, files at any depth."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.time import parse_rfc3339
from meterlake.operators.dedup import first_per_key
from meterlake.schemas import USAGE_COLUMNS
from meterlake.sources.lines import all_counts, count_of, json_rows, read_lines

# Wire fields (fixed values of the log format).
RECORD = """
    timestamp string, sessionId string, type string, uuid string, cwd string, requestId string,
    costUSD double, cost_usd double, isApiErrorMessage boolean,
    message struct<
        model: string, id: string,
        usage: struct<input_tokens: bigint, output_tokens: bigint,
                      cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint>>
"""
SYNTHETIC_MODEL = "<synthetic>"


def read(spark: SparkSession, paths: str | list[str], modified_since: datetime | None = None) -> DataFrame:
    return parse(read_lines(spark, paths, "*.jsonl", recursive=True, modified_since=modified_since))


def parse(lines: DataFrame) -> DataFrame:
    """Usage rows from ``value, _file, _ord``; repeats are removed before validity is tested."""
    return valid_usage(first_per_key(records(lines), "dedup_key"))


def records(lines: DataFrame) -> DataFrame:
    """Records that match the wire format, with their dedup key. Others are skipped."""
    fields = json_rows(lines, RECORD, "_file", "_ord")
    usage = F.col("message.usage")
    complete = (
        F.col("timestamp").isNotNull()
        & F.col("message.model").isNotNull()
        & usage["input_tokens"].isNotNull()
        & all_counts(
            usage["input_tokens"], usage["output_tokens"],
            usage["cache_creation_input_tokens"], usage["cache_read_input_tokens"],
        )
    )
    return fields.where(complete).withColumn("dedup_key", dedup_key(F.col("message.id"), F.col("requestId")))


def dedup_key(message_id: Column, request_id: Column) -> Column:
    """``message-request``, or whichever exists, else null."""
    return F.coalesce(F.concat(message_id, F.lit("-"), request_id), message_id, request_id)


def valid_usage(rows: DataFrame) -> DataFrame:
    return as_usage(rows).where("valid").select(*USAGE_COLUMNS)


def as_usage(rows: DataFrame) -> DataFrame:
    """Usage columns, the other columns of the records that dedup needs, and whether the record is ``valid`` usage."""
    ts = parse_rfc3339(F.col("timestamp"))
    model = F.col("message.model")
    usage = F.col("message.usage")
    valid = (
        ~F.coalesce("isApiErrorMessage", F.lit(False))
        & (F.coalesce("type", F.lit("assistant")) == "assistant")
        & (model != SYNTHETIC_MODEL)
        & F.col("ts").isNotNull()
    )
    generated = F.concat_ws("-", F.lit("generated"), F.unix_seconds("ts").cast("string"), model)
    return (
        rows.withColumn("ts", ts)
        .select(
            F.lit("claude").alias("provider"),
            F.coalesce("sessionId", generated).alias("session_id"),
            "ts",
            model.alias("model"),
            usage["input_tokens"].alias("input_tokens"),
            count_of(usage["output_tokens"]).alias("output_tokens"),
            count_of(usage["cache_creation_input_tokens"]).alias("cache_creation_tokens"),
            count_of(usage["cache_read_input_tokens"]).alias("cache_read_tokens"),
            F.coalesce("costUSD", "cost_usd").alias("total_cost"),
            last_component(F.col("cwd")).alias("project"),
            F.col("uuid").alias("instance_id"),
            "_file",
            "_ord",
            "dedup_key",
            valid.alias("valid"),
        )
    )


def last_component(path: Column) -> Column:
    """Last real component of a path; null for a root, ``.`` or ``..``."""
    trimmed = F.regexp_replace(path, r"(/+\.?)+$", "")
    name = F.regexp_extract(trimmed, r"([^/]+)$", 1)
    return F.when(~name.isin("", ".", ".."), name)
