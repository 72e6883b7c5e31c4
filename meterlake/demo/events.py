"""Usage table derived from the ``events`` test table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Model of each event type (fixed values of the test projection).
EVENT_MODELS = {
    "view": "claude-3-haiku",
    "click": "claude-3-5-sonnet",
    "purchase": "claude-3-opus-20240229",
    "signup": "claude-sonnet-4-5-20250929",
    "error": "mystery-model",
}

AS_OF = "2024-01-30T23:59:00+00:00"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def usage_from_events(events: DataFrame) -> DataFrame:
    model = " ".join(f"WHEN '{event_type}' THEN '{name}'" for event_type, name in EVENT_MODELS.items())
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).selectExpr(
        "'events' AS provider",
        "concat('s', user_id) AS session_id",
        "cast(ts AS timestamp) AS ts",
        f"CASE event_type {model} END AS model",
        "k * 10 AS input_tokens",
        "k AS output_tokens",
        "event_id % 50 AS cache_creation_tokens",
        "event_id % 200 AS cache_read_tokens",
        "if(event_id % 3 = 0, value, NULL) AS total_cost",
        "if(event_id % 11 <> 0, concat('proj', user_id % 7), NULL) AS project",
        "if(event_id % 4 <> 0, concat('inst', event_id % 4), NULL) AS instance_id",
        "'events' AS _file",
        "event_id AS _ord",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_from_events(read_events(spark, sf_dir))
