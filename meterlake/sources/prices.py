"""Price tables: model name -> USD per token."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.schemas import PRICES, RATES, RATE

# Default prices per token: input, output, cache creation, cache read (fixed values).
DEFAULT_PRICES = {
    "claude-3-opus": ("0.000015", "0.000075", "0.00001875", "0.0000015"),
    "claude-3-sonnet": ("0.000003", "0.000015", "0.00000375", "0.0000003"),
    "claude-3-haiku": ("0.00000025", "0.00000125", "0.0000003", "0.00000003"),
    "claude-3.5-sonnet": ("0.000003", "0.000015", "0.00000375", "0.0000003"),
    "claude-sonnet-4-5-20250929": ("0.000003", "0.000015", "0.00000375", "0.0000003"),
    "claude-sonnet-4.5": ("0.000003", "0.000015", "0.00000375", "0.0000003"),
    "claude-4.5-sonnet": ("0.000003", "0.000015", "0.00000375", "0.0000003"),
    "claude-2.1": ("0.000008", "0.000024", None, None),
    "claude-2": ("0.000008", "0.000024", None, None),
    "claude-instant-1.2": ("0.0000008", "0.0000024", None, None),
}


def default_prices(spark: SparkSession) -> DataFrame:
    """The default table as a local relation, whose size the planner knows."""
    columns = list(zip(*DEFAULT_PRICES.values()))
    rates = [
        pa.array([None if rate is None else Decimal(rate) for rate in column], pa.decimal128(18, 14))
        for column in columns
    ]
    table = pa.table([pa.array(DEFAULT_PRICES, pa.string()), *rates], names=["model", *RATES])
    return spark.createDataFrame(table, PRICES)


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """Reads ``{model: {rate name: number or null}}`` from JSON files.

    A model whose entry is not an object, or has a rate that is not a number,
    is left out; a rate that is missing stays null.
    """
    return parse_prices(spark.read.text(path, wholetext=True))


def parse_prices(documents: DataFrame) -> DataFrame:
    models = documents.select(F.explode(F.from_json("value", "map<string,string>")).alias("model", "_text"))
    entry_schema = ", ".join(f"{name} double" for name in RATES) + ", _corrupt string"
    entry = F.from_json("_text", entry_schema, {"columnNameOfCorruptRecord": "_corrupt"})
    return (
        models.where(F.col("_text").startswith("{"))
        .withColumn("_entry", entry)
        .where(F.col("_entry._corrupt").isNull())
        .select("model", *[F.col(f"_entry.{name}").cast(RATE).alias(name) for name in RATES])
    )


def merge_prices(preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """All preferred rows, and the fallback rows for models that the former lack."""
    return preferred.unionByName(fallback.join(preferred.select("model"), "model", "left_anti"))
