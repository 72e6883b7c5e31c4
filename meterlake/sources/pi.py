"""Pi logs: JSON lines in ``<project>/<session>.jsonl``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.time import parse_rfc3339
from meterlake.schemas import USAGE_COLUMNS
from meterlake.session import subfolders
from meterlake.sources.lines import all_counts, count_of, file_stem, json_rows, parent_name, read_lines

# Wire fields (fixed values of the log format).
RECORD = """
    timestamp string,
    message struct<role: string, model: string,
        usage: struct<input: bigint, output: bigint, cacheRead: bigint, cacheWrite: bigint, cost: struct<total: double>>>
"""
MODEL_PREFIX = "[pi] "


def read(spark: SparkSession, paths: str | list[str], modified_since: datetime | None = None) -> DataFrame:
    roots = [paths] if isinstance(paths, str) else list(paths)
    # folders are listed; a pattern down to the files would make every file a path to look up
    projects = [folder for root in roots for folder in subfolders(spark, root)]
    return parse(read_lines(spark, [projects] if projects else [], "*.jsonl", modified_since=modified_since))


def parse(lines: DataFrame) -> DataFrame:
    """Usage rows from ``value, _file, _ord``; every line stands alone."""
    usage = F.col("message.usage")
    rows = (
        json_rows(lines, RECORD, "_file", "_ord")
        .where((F.col("message.role") == "assistant") & usage.isNotNull())
        .where(all_counts(usage["input"], usage["output"], usage["cacheRead"], usage["cacheWrite"]))
        .where((count_of(usage["input"]) > 0) | (count_of(usage["output"]) > 0))
        .withColumn("ts", parse_rfc3339(F.col("timestamp")))
        .where(F.col("ts").isNotNull())
    )
    return rows.select(
        F.lit("pi").alias("provider"),
        file_stem(F.col("_file")).alias("session_id"),
        "ts",
        F.concat(F.lit(MODEL_PREFIX), F.coalesce("message.model", F.lit("unknown"))).alias("model"),
        count_of(usage["input"]).alias("input_tokens"),
        count_of(usage["output"]).alias("output_tokens"),
        count_of(usage["cacheWrite"]).alias("cache_creation_tokens"),
        count_of(usage["cacheRead"]).alias("cache_read_tokens"),
        usage["cost"]["total"].alias("total_cost"),
        parent_name(F.col("_file")).alias("project"),
        F.lit(None).cast("string").alias("instance_id"),
        "_file",
        "_ord",
    ).select(*USAGE_COLUMNS)
