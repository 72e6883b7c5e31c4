"""Display columns: the texts of the printed tables, without drawing them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.args import parse_instant, parse_zone
from meterlake.functions.models import short_name, short_names
from meterlake.functions.text import dollars, duration, grouped, local_minute
from meterlake.functions.time import instant, micros_between
from meterlake.operators.monitor import block_status, block_time_remaining
from meterlake.schemas import TOKENS


def with_display_columns(report: DataFrame, tz: str = "UTC", full_model_names: bool = False) -> DataFrame:
    """Adds a ``*_text`` column for every number, cost, time and model column of a report."""
    tz = parse_zone(tz)
    present = set(report.columns)
    texts = {f"{name}_text": grouped(F.col(name)) for name in [*TOKENS, "total_tokens"] if name in present}
    if "total_cost" in present:
        texts["total_cost_text"] = dollars(F.col("total_cost"))
    if "models_used" in present:
        models = F.array_join("models_used", ", ") if full_model_names else short_names(F.col("models_used"))
        texts["models_text"] = models
    if "model" in present:
        texts["model_text"] = F.col("model") if full_model_names else short_name(F.col("model"))
    for name in ("start_time", "end_time"):
        if name in present:
            texts[f"{name}_text"] = local_minute(F.col(name), tz)
    if {"start_time", "end_time"} <= present:
        texts["duration_text"] = duration(micros_between(F.col("start_time"), F.col("end_time")))
    return report.withColumns(texts)


def with_block_texts(blocks: DataFrame, as_of: str | datetime, tz: str = "UTC") -> DataFrame:
    """Status, remaining time and the start text of a block, which depends on its status."""
    tz = parse_zone(tz)
    now = instant(parse_instant(as_of))
    start = local_minute(F.col("start_time"), tz)
    gap = F.concat(
        start, F.lit(" - "), local_minute(F.col("end_time"), tz), F.lit(" ("),
        duration(micros_between(F.col("start_time"), F.col("end_time"))), F.lit(" gap)"),
    )
    running = F.concat(start, F.lit(" ("), duration(micros_between(F.col("start_time"), now)), F.lit(" elapsed)"))
    done = F.concat(
        start, F.lit(" ("), duration(micros_between(F.col("actual_start_time"), F.col("actual_end_time"))), F.lit(")")
    )
    return blocks.withColumns({
        "status": block_status(F.col("is_gap"), F.col("is_active")),
        "time_remaining": block_time_remaining(F.col("is_active"), F.col("end_time"), as_of),
        "start_text": F.when(F.col("is_gap"), gap).when(F.col("is_active"), running).otherwise(F.coalesce(done, start)),
    })
