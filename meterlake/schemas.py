"""Schemas and shared column names."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

TOKENS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]

#: Precision of money: 14 decimals hold every per-token price exactly, and a
#: decimal sum does not depend on the order in which partitions are merged.
MONEY = "decimal(28,14)"
RATE = "decimal(18,14)"

USAGE = T.StructType([
    T.StructField("provider", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("model", T.StringType(), False),
    *[T.StructField(name, T.LongType(), False) for name in TOKENS],
    T.StructField("total_cost", T.DoubleType(), True),
    T.StructField("project", T.StringType(), True),
    T.StructField("instance_id", T.StringType(), True),
    T.StructField("_file", T.StringType(), True),
    T.StructField("_ord", T.LongType(), True),
])
USAGE_COLUMNS = [field.name for field in USAGE]

# Field names of the price file (fixed values of the file format).
RATE_FIELDS = {
    "input_tokens": "input_cost_per_token",
    "output_tokens": "output_cost_per_token",
    "cache_creation_tokens": "cache_creation_input_token_cost",
    "cache_read_tokens": "cache_read_input_token_cost",
}
RATES = list(RATE_FIELDS.values())

PRICES = T.StructType(
    [T.StructField("model", T.StringType(), False)]
    + [T.StructField(name, T.DecimalType(18, 14), True) for name in RATES]
)


class CostMode(str, Enum):
    """Where the cost of an entry comes from."""

    AUTO = "auto"            # the logged cost, else computed from prices (unknown model: 0)
    CALCULATE = "calculate"  # always computed; an unknown model is an error
    DISPLAY = "display"      # only the logged cost; a missing one is an error

    @classmethod
    def parse(cls, text: "str | CostMode") -> "CostMode":
        if isinstance(text, cls):
            return text
        try:
            return cls(text.lower())
        except ValueError:
            raise ValueError(f"Invalid cost mode: {text}") from None
