"""Writing usage and reports as tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators.filters import UsageFilter
from meterlake.schemas import USAGE_COLUMNS


def write_usage(usage: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, one folder per provider and UTC day.

    ``read_stored`` then reads only the days of its range, and every report
    reads only its columns; raw JSON text allows neither. Rows are rebalanced
    by day, so AQE merges small days into one task and splits a busy day by size.
    """
    by_day = usage.withColumn("day", F.to_date("ts"))
    by_day.hint("rebalance", F.col("provider"), F.col("day")).write.mode(mode).partitionBy("provider", "day").parquet(path)


def read_stored(spark: SparkSession, path: str, chosen: UsageFilter | None = None) -> DataFrame:
    """Stored usage; a date range reads its days and one more on each side, as local days may begin then."""
    usage, chosen = spark.read.parquet(path), chosen or UsageFilter()
    if chosen.since:
        usage = usage.where(F.col("day") >= F.lit(chosen.since - timedelta(days=1)))
    if chosen.until:
        usage = usage.where(F.col("day") <= F.lit(chosen.until + timedelta(days=1)))
    return chosen.apply(usage.drop("day")).select(*USAGE_COLUMNS)


def write_report(report: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    report.write.mode(mode).format(fmt).save(path)
