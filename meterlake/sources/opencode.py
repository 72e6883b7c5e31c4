"""OpenCode logs: one JSON object per message file."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.args import parse_instant
from meterlake.functions.models import OPENCODE_ALIASES, apply_aliases
from meterlake.functions.time import instant
from meterlake.operators.dedup import first_per_key
from meterlake.schemas import USAGE_COLUMNS
from meterlake.sources.lines import all_counts, count_of, json_rows, read_documents

# Wire fields (fixed values of the log format).
RECORD = """
    id string, sessionID string, modelID string, cost double,
    time struct<created: double>,
    tokens struct<input: bigint, output: bigint, cache: struct<read: bigint, write: bigint>>
"""
# Largest epoch second that counts as a time; others fall back to the reading time.
LAST_SECOND = 8_200_000_000_000


def read(
    spark: SparkSession, paths: str | list[str], as_of: str | datetime, modified_since: datetime | None = None
) -> DataFrame:
    return parse(read_documents(spark, paths, "*.json", modified_since), as_of)


def parse(documents: DataFrame, as_of: str | datetime) -> DataFrame:
    """Usage rows from ``value, _file``; a message without a time gets ``as_of``."""
    tokens, cache = F.col("tokens"), F.col("tokens.cache")
    messages = (
        json_rows(documents.withColumn("_ord", F.lit(0).cast("bigint")), RECORD, "_file", "_ord")
        .where(F.col("id").isNotNull() & F.col("sessionID").isNotNull() & F.col("modelID").isNotNull())
        .where(all_counts(tokens["input"], tokens["output"], cache["read"], cache["write"]))
    )
    kept = first_per_key(messages, "id").where((count_of(tokens["input"]) > 0) | (count_of(tokens["output"]) > 0))
    return kept.select(
        F.lit("opencode").alias("provider"),
        F.col("sessionID").alias("session_id"),
        F.coalesce(_created(F.col("time.created")), instant(parse_instant(as_of))).alias("ts"),
        apply_aliases(F.col("modelID"), OPENCODE_ALIASES).alias("model"),
        count_of(tokens["input"]).alias("input_tokens"),
        count_of(tokens["output"]).alias("output_tokens"),
        count_of(cache["write"]).alias("cache_creation_tokens"),
        count_of(cache["read"]).alias("cache_read_tokens"),
        F.col("cost").alias("total_cost"),
        F.lit(None).cast("string").alias("project"),
        F.lit(None).cast("string").alias("instance_id"),
        "_file",
        "_ord",
    ).select(*USAGE_COLUMNS)


def _created(seconds: Column) -> Column:
    """Epoch seconds with a fraction, cut to microseconds."""
    usable = F.when(F.abs(seconds) < LAST_SECOND, seconds)
    whole = usable.cast("bigint")
    nanos = F.greatest(((usable - whole) * 1e9).cast("bigint"), F.lit(0))
    return F.timestamp_micros(whole * 1_000_000 + F.call_function("div", nanos, F.lit(1000)))
