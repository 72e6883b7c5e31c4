"""Log readers, one per provider, all with the same usage schema."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.sources import amp, claude, codex, opencode, pi
from meterlake.sources.lines import json_rows

PROVIDERS = ("claude", "codex", "opencode", "amp", "pi")


def read_usage(
    spark: SparkSession,
    provider: str,
    paths: str | list[str],
    as_of: str | datetime | None = None,
    modified_since: datetime | None = None,
) -> DataFrame:
    """Usage of one provider. ``modified_since`` skips files that are older (inclusive bound).

    ``as_of`` is the time given to OpenCode messages that have none.
    """
    if provider == "opencode":
        if as_of is None:
            raise ValueError("opencode needs as_of, the time of messages without one")
        return opencode.read(spark, paths, as_of, modified_since)
    readers = {"claude": claude.read, "codex": codex.read, "amp": amp.read, "pi": pi.read}
    if provider not in readers:
        raise ValueError(f"Unknown provider: {provider}. Expected one of: {', '.join(PROVIDERS)}")
    return readers[provider](spark, paths, modified_since)


def union_usage(*tables: DataFrame) -> DataFrame:
    """All providers in one table."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def skipped_lines(lines: DataFrame, record_schema: str) -> DataFrame:
    """Per file: lines that are not blank, and those of them that match no record of the wire format."""
    filled = lines.where(F.length(F.trim("value")) > 0).groupBy("_file").agg(F.count("*").alias("lines"))
    matching = json_rows(lines, record_schema, "_file").groupBy("_file").agg(F.count("*").alias("_matching"))
    return filled.join(matching, "_file", "left").select(
        "_file", "lines", (F.col("lines") - F.coalesce("_matching", F.lit(0))).alias("skipped")
    )
