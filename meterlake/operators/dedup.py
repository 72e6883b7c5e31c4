"""First-wins removal of repeated records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, file: str = "_file", ordinal: str = "_ord") -> DataFrame:
    """Keep the first row of every key in (file, position) order; rows without a key all stay.

    Spark plans ``row_number() = 1`` with a group limit before the shuffle, so
    every map task sends at most one row per key: a group of copies that holds
    a third of the input shrinks to one row per task. Rows without a key get
    their own position as second partition column; they spread evenly and need
    no separate scan.
    """
    unkeyed = F.when(F.col(key).isNull(), F.struct(file, ordinal))
    ranked = Window.partitionBy(F.col(key), unkeyed).orderBy(file, ordinal)
    return (
        df.withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )
