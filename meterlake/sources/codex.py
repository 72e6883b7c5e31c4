"""Codex logs: one JSON-lines file per session, with running token totals.

Two things in a session depend on earlier lines: the model (set by
``turn_context`` lines) and the previous running total of that model. Both are
"last known value" look-backs. They run per *chunk* (one input split of a
file), whose size is bounded. What a chunk inherits from the chunks before it
comes from a small summary, one row per chunk and model, and is fed in as synthetic first rows. A session file of any size is
thus processed by as many tasks as it has splits.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions.models import CODEX_ALIASES, CODEX_DEFAULT_MODEL, apply_aliases
from meterlake.functions.time import parse_rfc3339
from meterlake.schemas import USAGE_COLUMNS
from meterlake.session import stage
from meterlake.sources.lines import all_counts, count_of, file_stem, json_rows, read_lines

# Wire fields (fixed values of the log format).
_TOTALS = """struct<input_tokens: bigint, cached_input_tokens: bigint, cache_read_tokens: bigint,
    cache_read_input_tokens: bigint, output_tokens: bigint, total_tokens: bigint>"""
RECORD = f"""
    type string, timestamp string, model_id string,
    payload struct<type: string, info: struct<total_token_usage: {_TOTALS}, last_token_usage: {_TOTALS}>>
"""
BEFORE_CHUNK = -1
WRITERS_PER_CORE = 16


def read(spark: SparkSession, paths: str | list[str], modified_since: datetime | None = None) -> DataFrame:
    return parse(read_lines(spark, paths, "*.jsonl", modified_since=modified_since))


def parse(lines: DataFrame) -> DataFrame:
    """Usage rows from ``value, _file, _chunk, _ord``.

    The few fields that matter are parsed once and written, with the chunks of
    this one scan; what chunks inherit and the rows are both derived from that
    table. A second scan could be split at other places. Tasks write several splits to a
    file, as small logs have very many.
    """
    tasks = WRITERS_PER_CORE * lines.sparkSession.sparkContext.defaultParallelism
    events = stage(_events(lines).coalesce(tasks))
    deltas = _deltas(events, _inherited(events))
    return deltas.where((F.col("input_tokens") > 0) | (F.col("output_tokens") > 0)).select(
        F.lit("codex").alias("provider"),
        file_stem(F.col("_file")).alias("session_id"),
        "ts",
        "model",
        "input_tokens",
        "output_tokens",
        F.lit(0).cast("bigint").alias("cache_creation_tokens"),
        "cache_read_tokens",
        F.lit(None).cast("double").alias("total_cost"),
        F.lit(None).cast("string").alias("project"),
        F.lit(None).cast("string").alias("instance_id"),
        "_file",
        "_ord",
    ).select(*USAGE_COLUMNS)


def _counts(totals: Column) -> Column:
    cached, read = count_of(totals["cached_input_tokens"]), count_of(
        F.coalesce(totals["cache_read_tokens"], totals["cache_read_input_tokens"])
    )
    return F.when(totals.isNotNull(), F.struct(
        count_of(totals["input_tokens"]).alias("input"),
        count_of(totals["output_tokens"]).alias("output"),
        F.when(cached > 0, cached).otherwise(read).alias("cache"),
    ))


def _unsigned(totals: Column) -> Column:
    names = ["input_tokens", "cached_input_tokens", "cache_read_tokens", "cache_read_input_tokens", "output_tokens", "total_tokens"]
    return totals.isNull() | all_counts(*[totals[name] for name in names])


def _events(lines: DataFrame) -> DataFrame:
    """Lines that matter: model changes, and token counts with a valid time."""
    parsed = json_rows(lines, RECORD, "_file", "_chunk", "_ord")
    info = F.col("payload.info")
    sets_model = F.col("type") == "turn_context"
    counts = (
        (F.col("type") == "event_msg") & (F.col("payload.type") == "token_count")
        & info.isNotNull() & F.col("ts").isNotNull()
    )
    return (
        parsed.withColumn("ts", parse_rfc3339(F.col("timestamp")))
        .where(_unsigned(info["total_token_usage"]) & _unsigned(info["last_token_usage"]))
        .where((sets_model & F.col("model_id").isNotNull()) | counts)
        .select(
            "_file", "_chunk", "_ord",
            F.when(counts, F.col("ts")).alias("ts"),
            F.when(sets_model, apply_aliases(F.col("model_id"), CODEX_ALIASES)).alias("set_model"),
            F.when(counts, _counts(info["total_token_usage"])).alias("total"),
            F.when(counts, _counts(info["last_token_usage"])).alias("last"),
        )
    )


def _model_so_far() -> Column:
    """Latest model set in the chunk up to and including a row; null before the first."""
    rows = Window.partitionBy("_file", "_chunk").orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0)
    return F.last("set_model", ignorenulls=True).over(rows)


def _inherited(events: DataFrame) -> DataFrame:
    """What each chunk inherits: the model, and per model the last running total.

    First every chunk is summed up by itself; its rows before the first model
    line have no model yet. The windows after that run over the summary. Their
    frames end one chunk before the current, and since positions rise along a
    file, the maximum of (position, value) is the latest value.
    """
    position_and = {name: F.when(F.col(name).isNotNull(), F.struct("_ord", name)) for name in ("set_model", "total")}
    summary = (
        events.withColumn("_local", _model_so_far())
        .groupBy("_file", "_chunk", "_local")
        .agg(*[F.max(value).alias(f"_latest_{name}") for name, value in position_and.items()])
    )

    def earlier_chunks(*keys: str):
        return Window.partitionBy("_file", *keys).orderBy("_chunk").rangeBetween(Window.unboundedPreceding, -1)

    return (
        summary.withColumn("_model", F.max("_latest_set_model").over(earlier_chunks()))
        .withColumn("inherited_by", F.coalesce("_local", "_model.set_model", F.lit(CODEX_DEFAULT_MODEL)))
        .withColumn("_total", F.max("_latest_total").over(earlier_chunks("inherited_by")))
        .where(F.col("_model").isNotNull() | F.col("_total").isNotNull())
        .select(
            "_file", "_chunk", F.lit(BEFORE_CHUNK).cast("bigint").alias("_ord"),
            F.col("_model.set_model").alias("set_model"), F.col("_total.total").alias("total"), "inherited_by",
        )
    )


def _deltas(events: DataFrame, inherited: DataFrame) -> DataFrame:
    """Tokens of each count: its own delta if given, else the rise of the running total."""
    rows = events.unionByName(inherited, allowMissingColumns=True)
    active = F.coalesce("inherited_by", _model_so_far(), F.lit(CODEX_DEFAULT_MODEL))
    counts = rows.withColumn("model", active).where(F.col("ts").isNotNull() | F.col("inherited_by").isNotNull())
    before = (
        Window.partitionBy("_file", "_chunk", "model").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("bigint")

    def tokens(part: str) -> Column:
        rise = F.greatest(F.col("total")[part] - F.coalesce(F.col("_previous")[part], zero), zero)
        return F.when(F.col("last").isNotNull(), F.col("last")[part]).otherwise(F.coalesce(rise, zero))

    with_previous = counts.withColumn("_previous", F.last("total", ignorenulls=True).over(before))
    return with_previous.where(F.col("ts").isNotNull()).select(
        "_file", "_ord", "ts", "model",
        tokens("input").alias("input_tokens"),
        tokens("output").alias("output_tokens"),
        tokens("cache").alias("cache_read_tokens"),
    )
