"""The queries of the driver contract: each report and operator over the whole ``events`` table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyarrow.fs import LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.demo import wire
from meterlake.demo.events import AS_OF, read_events, usage, usage_from_events
from meterlake.functions.models import short_name, status_name
from meterlake.operators.blocks import (
    billing_blocks, block_projects, block_sessions, blocks_from_sessions, filter_blocks, with_token_warnings,
)
from meterlake.operators.dedup import first_per_key
from meterlake.operators.filters import MonthFilter, UsageFilter
from meterlake.operators.monitor import active_sessions, historical_max, spend_snapshot, with_burn_rate
from meterlake.operators.pricing import resolve_models, unknown_models, with_cost
from meterlake.plans import reports
from meterlake.schemas import TOKENS
from meterlake.session import pin_utc, scratch_dir, stage
from meterlake.sinks.display import with_block_texts, with_display_columns
from meterlake.sinks.documents import CLOSING, OPENING, ROWS, block_lines, daily_detailed_lines, document_lines
from meterlake.sources import amp, claude, codex, opencode, pi, read_usage, union_usage
from meterlake.sources.prices import default_prices, load_prices, merge_prices
from meterlake.streaming.active import active_counts, read_active, start_active_watch
from meterlake.streaming.blocks import BlockWatch, start_block_watch
from meterlake.streaming.folder import refresh, watched_usage
from meterlake.streaming.live import read_meters, start_watch
from meterlake.streaming.retract import dedup_changes, settled_meters, start_exact_watch, state_conf
from meterlake.streaming.tail import open_folder, tail_lines

Query = Callable[[SparkSession, str], DataFrame]

NEW_YORK = "America/New_York"

# Prices that a newer price list would bring (fixed values of the test).
NEWER_PRICES = """
    SELECT * FROM VALUES
      ('claude-3-haiku', 0.000002, 0.000004, 0.000001, NULL),
      ('mystery-model', 0.00001, 0.00002, NULL, 0.000003)
    AS t(model, input_cost_per_token, output_cost_per_token,
         cache_creation_input_token_cost, cache_read_input_token_cost)
"""


def flat(df: DataFrame) -> DataFrame:
    """Plain columns that compare equal in any engine: texts for times and lists, eight decimals for money
    (prices have no more, so the rounding only removes binary noise)."""
    columns = []
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column, ",")
        elif isinstance(kind, (T.DoubleType, T.DecimalType)):
            column = F.round(column, 8).cast("double")
        elif isinstance(kind, T.IntegerType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _query(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """A query that needs the usage table and the default prices."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        return flat(build(usage(spark, sf_dir), default_prices(spark)))

    return run


def _wire_query(build: Callable[[DataFrame], DataFrame]) -> Query:
    """A query that starts from the raw events, to render them as log lines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        return flat(build(read_events(spark, sf_dir)))

    return run


def _stream_query(report) -> Query:
    """The same report, built by a streaming job that reads the table in micro-batches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        stream = (
            spark.readStream.schema(read_events(spark, sf_dir).schema)
            .option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        )
        folder = f"{scratch_dir(spark)}/watch-{uuid.uuid4()}"
        start_watch(usage_from_events(stream), report, f"{folder}/meters", f"{folder}/checkpoint").awaitTermination()
        return flat(report.from_meters(read_meters(spark, f"{folder}/meters"), default_prices(spark)))

    return run


def _in_batches(spark: SparkSession, sf_dir: str, folder: str, batches: int) -> DataFrame:
    """The shuffled events as a stream of ``batches`` micro-batches, each of as many files as there are cores."""
    events, files = read_events(spark, sf_dir), spark.sparkContext.defaultParallelism
    events.repartition(batches * files, "event_id").write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _batches_query(report, batches: int = 4) -> Query:
    """The report by a streaming job, over the events in several micro-batches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        folder = f"{scratch_dir(spark)}/watch-{uuid.uuid4()}"
        files = _in_batches(spark, sf_dir, f"{folder}/events", batches)
        start_watch(usage_from_events(files), report, f"{folder}/meters", f"{folder}/checkpoint").awaitTermination()
        return flat(report.from_meters(read_meters(spark, f"{folder}/meters"), default_prices(spark)))

    return run


def _growing_logs(events: DataFrame) -> DataFrame:
    """Usage by a watch on real log files that hold the earlier half of their lines first, then all."""
    spark, lines = events.sparkSession, stage(wire.claude_lines(events))
    half = lines.agg(F.percentile_approx("_ord", 0.5)).first()[0] or 0
    folder = wire.write_logs(lines.where(F.col("_ord") < half))
    table = f"{scratch_dir(spark)}/watch-{uuid.uuid4()}"
    refresh(spark, folder, table)
    refresh(spark, wire.write_logs(lines, folder), table)
    return watched_usage(spark, table)


def _tailed(report) -> Query:
    """The report by a watch that tails real log files and keeps the first copy of each record exactly.

    The files with the later half of the names come first, then the beginnings of the other
    files, then their rest: copies that win arrive after those they replace.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        state_conf(spark)
        lines = stage(wire.claude_lines(read_events(spark, sf_dir)))
        middle = lines.agg(F.percentile_approx("_ord", 0.5), F.percentile_approx(F.ascii(F.substring("_file", -7, 1)), 0.5)).first()
        late, early = F.ascii(F.substring("_file", -7, 1)) > (middle[1] or 0), F.col("_ord") < (middle[0] or 0)
        scratch = f"{scratch_dir(spark)}/watch-{uuid.uuid4()}"
        folder = None
        for part in (late, late | early, F.lit(True)):
            folder = wire.write_logs(lines.where(part), folder)
            records = claude.records(tail_lines(spark, folder, f"{scratch}/tail"))
            start_exact_watch(dedup_changes(records), report, f"{scratch}/table", f"{scratch}/checkpoint").awaitTermination()
        return flat(report.from_meters(settled_meters(spark, f"{scratch}/table", report), default_prices(spark)))

    return run


def _block_watch(report: reports.BlockReport, result: Callable[[BlockWatch], DataFrame], batches: int = 3) -> Query:
    """What a watch of blocks has after the events came in several shuffled micro-batches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        folder = f"{scratch_dir(spark)}/watch-{uuid.uuid4()}"
        files = _in_batches(spark, sf_dir, f"{folder}/events", batches)
        changes = usage_from_events(files).withColumn("sign", F.lit(1))
        start_block_watch(changes, report, default_prices(spark), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
        return flat(result(BlockWatch(spark, f"{folder}/table", report, default_prices(spark))))

    return run


def _active_watch(minutes: int, batches: int = 3) -> Query:
    """Sessions with entries in the last minutes before the latest event, by a watch in which sessions end."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        state_conf(spark)
        folder = f"{scratch_dir(spark)}/watch-{uuid.uuid4()}"
        files = _in_batches(spark, sf_dir, f"{folder}/events", batches)
        start_active_watch(active_counts(usage_from_events(files), minutes), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
        return flat(read_active(spark, f"{folder}/table"))

    return run


def _read_files(provider: str, lines: Callable[[DataFrame], DataFrame], deep: bool = False) -> Query:
    """The events as real log files, read by the provider's reader."""

    def build(events: DataFrame) -> DataFrame:
        folder = wire.write_logs(lines(events))
        return _usage_columns(read_usage(events.sparkSession, provider, f"{folder}/*" if deep else folder))

    return _wire_query(build)


def _recent_files(events: DataFrame) -> DataFrame:
    """Files of sessions with an even number were written to lately; those of the others are older than the limit."""
    spark, limit = events.sparkSession, datetime(2024, 1, 1, tzinfo=timezone.utc)
    older, at_limit = F.lit(limit - timedelta(seconds=1)), F.lit(limit)
    modified = F.when(F.col("_file").rlike(r"/s[^/]*[13579]\.jsonl$"), older).when(F.col("_file").rlike(r"/s[^/]*[02468]\.jsonl$"), at_limit)
    folder = wire.write_logs(wire.claude_lines(events), modified=modified)
    if not isinstance(open_folder(folder)[0], LocalFileSystem):
        wire.set_file_time(spark, f"{folder}/*/s*[13579].jsonl", limit - timedelta(seconds=1))
        wire.set_file_time(spark, f"{folder}/*/s*[02468].jsonl", limit)
    return _usage_columns(read_usage(spark, "claude", folder, modified_since=limit))


def parsed_claude(events: DataFrame) -> DataFrame:
    return claude.parse(wire.claude_lines(events))


def parsed_codex(events: DataFrame) -> DataFrame:
    return codex.parse(wire.codex_lines(events))


def parsed_opencode(events: DataFrame) -> DataFrame:
    return opencode.parse(wire.opencode_documents(events), AS_OF)


def parsed_amp(events: DataFrame) -> DataFrame:
    return amp.parse(wire.amp_documents(events))


def parsed_pi(events: DataFrame) -> DataFrame:
    return pi.parse(wire.pi_lines(events))


def _usage_columns(table: DataFrame) -> DataFrame:
    return table.select("session_id", "ts", "model", *TOKENS, "total_cost", "project", "instance_id")


def _provider_union(events: DataFrame) -> DataFrame:
    everything = union_usage(*[parse(events) for parse in (parsed_claude, parsed_codex, parsed_opencode, parsed_amp, parsed_pi)])
    return everything.groupBy("provider").agg(
        F.count("*").alias("entries"), *[F.sum(name).alias(name) for name in TOKENS],
        F.sum(F.col("total_cost").cast("decimal(28,14)")).alias("total_cost"),
    )


def _daily_by_price_file(u: DataFrame, p: DataFrame) -> DataFrame:
    """The daily report with prices that were read from a price file."""
    spark = u.sparkSession
    folder = f"{scratch_dir(spark)}/prices-{uuid.uuid4()}"
    entries = F.map_from_entries(F.collect_list(F.struct("model", F.struct(*p.columns[1:]))))
    p.agg(F.to_json(entries).alias("value")).write.text(folder)
    return reports.daily(u, load_prices(spark, folder))


def _document_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Report rows read back from the lines of a JSON document."""
    rows = lines.where(F.col("section") == ROWS).select(F.from_json(F.ltrim(F.col("line"), F.lit(",")), schema).alias("r"))
    return rows.select("r.*").select("*", "tokens.*").drop("tokens").withColumnRenamed("total", "total_tokens")


_TOKENS_JSON = "tokens struct<input_tokens: bigint, output_tokens: bigint, cache_creation_tokens: bigint, cache_read_tokens: bigint, total: bigint>"


def _whole_document(lines: DataFrame, key: str, fields: str) -> DataFrame:
    """Rows of a document and its totals, which have ``totals`` as their key."""
    rows = _document_rows(lines, f"{fields}, {_TOKENS_JSON}, total_cost double")
    text = F.regexp_extract("line", r'^\],"totals":(.*)\}$', 1)
    closing = lines.where(F.col("section") == CLOSING).select(F.from_json(text, f"{_TOKENS_JSON}, total_cost double").alias("r"))
    totals = closing.select(F.lit("totals").alias(key), "r.tokens.*", "r.total_cost").withColumnRenamed("total", "total_tokens")
    return rows.unionByName(totals, allowMissingColumns=True)


def _block_objects(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """Blocks read back from the opening lines of the block document."""
    heads = block_lines(blocks, members).where((F.col("section") == ROWS) & (F.col("step") == OPENING))
    schema = f"""start_time timestamp, end_time timestamp, is_active boolean, is_gap boolean, session_count bigint,
        {_TOKENS_JSON}, total_cost double, models_used array<string>"""
    rows = heads.select(F.from_json(F.concat(F.ltrim(F.col("line"), F.lit(",")), F.lit("]}")), schema).alias("r"))
    return rows.select("r.*").select("*", "tokens.*").drop("tokens").withColumnRenamed("total", "total_tokens")


def _block_ids(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """Session ids listed in the block document, counted over all blocks."""
    lines = block_lines(blocks, members)
    is_id = (F.col("section") == ROWS) & (F.col("step") == ROWS)
    return lines.where(is_id).groupBy(
        F.replace(F.ltrim(F.col("line"), F.lit(",")), F.lit('"'), F.lit("")).alias("session_id")
    ).agg(F.count("*").alias("blocks"))


def _entry_lines(report: DataFrame, entries: DataFrame) -> DataFrame:
    lines = daily_detailed_lines(report, entries)
    parsed = lines.where((F.col("section") == ROWS) & (F.col("step") == ROWS)).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.from_json(F.ltrim(F.col("line"), F.lit(",")), f"session_id string, model string, cost double, {_TOKENS_JSON}").alias("r"),
    )
    return parsed.groupBy("date").agg(
        F.count("*").alias("entries"),
        F.sum("r.tokens.total").alias("total_tokens"),
        F.sum(F.col("r.cost").cast("decimal(28,14)")).alias("cost"),
    )


def _daily_snapshot(u: DataFrame, p: DataFrame) -> DataFrame:
    return spend_snapshot(u, u.select("session_id"), p, AS_OF, 200.0, NEW_YORK).drop("cost_text")


def _requested_snapshot(u: DataFrame, p: DataFrame) -> DataFrame:
    """Sessions that worked on one project, and one that has no usage."""
    nobody = u.sparkSession.range(1).select(F.lit("nobody").alias("session_id"))
    wanted = u.where("project = 'proj3'").select("session_id").unionByName(nobody)
    return spend_snapshot(u, wanted, p, AS_OF, 200.0, NEW_YORK)


def _model_families(u: DataFrame, p: DataFrame) -> DataFrame:
    priced = with_cost(u, p)
    return priced.groupBy(short_name(F.col("model")).alias("family"), status_name(F.col("model")).alias("status_name")).agg(
        F.count("*").alias("entries"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost")
    )


def _cost_rows(mode: str) -> Query:
    """Cost of each entry; the part that the strict mode would refuse is left null."""
    return _query(lambda u, p: with_cost(u, p, mode, strict=False).select(F.col("_ord").alias("event_id"), "model", "cost"))


def _monitor(u: DataFrame, p: DataFrame) -> DataFrame:
    blocks = stage(billing_blocks(u, p, AS_OF))
    return with_burn_rate(blocks, blocks, AS_OF).select(
        "start_time", "total_cost", "max_cost", "block_progress", "burn_rate", "remaining_minutes", "projected_cost",
        "usage_percent", "projection_percent", "projection_status", "burn_status",
    )


QUERIES: dict[str, Query] = {
    "daily": _query(lambda u, p: reports.daily(u, p)),
    "daily_staged": _query(lambda u, p: reports.daily_report().run(u, p, staged=True)),
    "blocks_staged": _query(lambda u, p: reports.BlockReport(AS_OF).run(u, p, staged=True)),
    "daily_ny": _query(lambda u, p: reports.daily(u, p, tz=NEW_YORK)),
    "daily_detailed": _query(lambda u, p: reports.daily_detailed(u, p).drop("_file").withColumnRenamed("_ord", "event_id")),
    "daily_by_instance": _query(lambda u, p: reports.daily_by_instance(u, p)),
    "sessions": _query(lambda u, p: reports.sessions(u, p)),
    "monthly": _query(lambda u, p: reports.monthly(u, p, tz=NEW_YORK)),
    "weekly_sunday": _query(lambda u, p: reports.weekly(u, p)),
    "weekly_wednesday": _query(lambda u, p: reports.weekly(u, p, start_of_week="wednesday")),
    "totals": _query(lambda u, p: reports.totals(reports.sessions(u, p))),
    "totals_rollup": _query(lambda u, p: reports.with_totals(reports.daily(u, p), "date")),
    "date_project_filter": _query(lambda u, p: reports.primary_provider_report(
        u, p, "daily", usage_filter=UsageFilter("2024-01-10", "2024-01-20", "proj3", NEW_YORK))),
    "month_filter": _query(lambda u, p: reports.monthly(u, p, tz=NEW_YORK, months=MonthFilter(until="2023-12"))),
    "week_month_filter": _query(lambda u, p: reports.weekly(u, p, months=MonthFilter(since="2024-01"))),
    "monthly_primary_rules": _query(lambda u, p: reports.primary_provider_report(
        u, p, "monthly", usage_filter=UsageFilter("2024-01-10", "2024-01-20", "proj3"))),
    "monthly_other_rules": _query(lambda u, p: reports.other_provider_report(
        u, p, "monthly", usage_filter=UsageFilter("2024-01-10", "2024-01-20", "proj3"))),
    "cost_auto": _cost_rows("auto"),
    "cost_calculate": _cost_rows("calculate"),
    "cost_display": _cost_rows("display"),
    "price_resolution": _query(lambda u, p: resolve_models(u, p)),
    "unknown_models": _query(lambda u, p: unknown_models(u, p)),
    "price_merge": _query(lambda u, p: reports.daily(u, merge_prices(
        u.sparkSession.sql(NEWER_PRICES).select("model", *[F.col(c).cast("decimal(18,14)").alias(c) for c in p.columns[1:]]), p))),
    "price_file": _query(_daily_by_price_file),
    "dedup_claude": _wire_query(lambda e: first_per_key(claude.records(wire.claude_lines(e)), "dedup_key").select(
        "dedup_key", F.col("_ord").alias("event_id"))),
    "parse_claude": _wire_query(lambda e: _usage_columns(parsed_claude(e))),
    "parse_codex_delta": _wire_query(lambda e: _usage_columns(parsed_codex(e))),
    "parse_opencode": _wire_query(lambda e: _usage_columns(parsed_opencode(e))),
    "parse_amp": _wire_query(lambda e: _usage_columns(parsed_amp(e))),
    "parse_pi": _wire_query(lambda e: _usage_columns(parsed_pi(e))),
    "read_claude": _read_files("claude", wire.claude_lines),
    "read_claude_recent": _wire_query(_recent_files),
    "read_codex": _read_files("codex", wire.codex_lines, deep=True),
    "read_amp": _read_files("amp", wire.amp_files, deep=True),
    "read_pi": _read_files("pi", wire.pi_lines),
    "provider_union": _wire_query(_provider_union),
    "blocks_global": _query(lambda u, p: billing_blocks(u, p, AS_OF)),
    "blocks_by_model": _query(lambda u, p: billing_blocks(u, p, AS_OF, keys=["model"])),
    "blocks_by_project": _query(lambda u, p: billing_blocks(u, p, AS_OF, keys=["project"])),
    "blocks_by_session": _query(lambda u, p: billing_blocks(u, p, AS_OF, keys=["session_id"])),
    "blocks_fractional": _query(lambda u, p: billing_blocks(u, p, AS_OF, hours=2.5, keys=["session_id"])),
    "blocks_below_an_hour": _query(lambda u, p: billing_blocks(u, p, AS_OF, hours=0.25)),
    "block_gaps": _query(lambda u, p: billing_blocks(u, p, AS_OF, keys=["session_id"]).where("is_gap").select(
        "session_id", "start_time", "end_time", "total_tokens")),
    "block_sessions": _query(lambda u, p: block_sessions(u, p)),
    "blocks_legacy": _query(lambda u, p: blocks_from_sessions(reports.sessions(u, p), AS_OF)),
    "block_filters": _query(lambda u, p: filter_blocks(
        billing_blocks(u, p, AS_OF, keys=["session_id"]), AS_OF, "2024-01-10", "2024-01-20", "proj3")),
    "block_projects": _query(lambda u, p: block_projects(u)),
    "block_filters_by_rows": _query(lambda u, p: filter_blocks(
        billing_blocks(u, p, AS_OF, keys=["session_id"], project_sets=False), AS_OF, "2024-01-10", "2024-01-20", "proj3",
        projects=block_projects(u, keys=["session_id"])).drop("projects_used")),
    "blocks_active_recent": _query(lambda u, p: filter_blocks(
        billing_blocks(u, p, AS_OF, keys=["session_id"]), AS_OF, active=True, recent=True)),
    "token_warnings": _query(lambda u, p: with_token_warnings(billing_blocks(u, p, AS_OF), "0.5%").select(
        "start_time", "total_tokens", "warning")),
    "historical_max": _query(lambda u, p: historical_max(billing_blocks(u, p, AS_OF))),
    "burn_projection": _query(_monitor),
    "active_sessions": _query(lambda u, p: active_sessions(u, AS_OF)),
    "spend_snapshot": _query(_daily_snapshot),
    "spend_snapshot_requests": _query(_requested_snapshot),
    "usage_by_model_family": _query(_model_families),
    "display_daily": _query(lambda u, p: with_display_columns(reports.daily(u, p)).select(
        "date", "input_tokens_text", "total_tokens_text", "total_cost_text", "models_text")),
    "display_blocks": _query(lambda u, p: with_block_texts(
        billing_blocks(u, p, AS_OF, keys=["session_id"]), AS_OF, NEW_YORK).select(
        "session_id", "start_text", "status", "time_remaining")),
    "json_sessions": _query(lambda u, p: _whole_document(
        document_lines(reports.sessions(u, p), "sessions"), "session_id",
        "session_id string, start_time string, duration_seconds bigint, model string")),
    "json_weekly": _query(lambda u, p: _whole_document(
        document_lines(reports.weekly(u, p), "weekly"), "week", "week string, active_days bigint")),
    "json_daily_entries": _query(lambda u, p: _entry_lines(reports.daily(u, p), reports.daily_detailed(u, p))),
    "json_daily": _query(lambda u, p: _whole_document(
        document_lines(reports.daily(u, p), "daily"), "date", "date string, models_used array<string>")),
    "json_by_instance": _query(lambda u, p: _whole_document(
        document_lines(reports.daily_by_instance(u, p), "daily_by_instance"), "date",
        "date string, instance_id string, models_used array<string>")),
    "json_monthly": _query(lambda u, p: _whole_document(
        document_lines(reports.monthly(u, p, tz=NEW_YORK), "monthly"), "month", "month string, active_days bigint")),
    "json_blocks": _query(lambda u, p: _block_objects(billing_blocks(u, p, AS_OF), block_sessions(u, p))),
    "json_block_sessions": _query(lambda u, p: _block_ids(billing_blocks(u, p, AS_OF), block_sessions(u, p))),
    "stream_daily": _stream_query(reports.daily_report()),
    "stream_by_instance": _stream_query(reports.daily_by_instance_report()),
    "stream_monthly": _stream_query(reports.monthly_report(NEW_YORK)),
    "stream_weekly": _stream_query(reports.weekly_report()),
    "stream_monthly_bits": _batches_query(reports.monthly_bits_report(NEW_YORK)),
    "stream_weekly_bits": _batches_query(reports.weekly_bits_report()),
    "stream_sessions": _stream_query(reports.session_report()),
    "stream_blocks": _stream_query(reports.BlockReport(AS_OF)),
    "stream_blocks_below_an_hour": _batches_query(reports.BlockReport(AS_OF, hours=0.25)),
    "stream_tail_sessions": _tailed(reports.session_report()),
    "stream_active_sessions": _active_watch(24 * 60),
    "stream_block_watch": _block_watch(reports.BlockReport(AS_OF, keys=("project",)), lambda w: w.current()),
    "stream_block_maximum": _block_watch(reports.BlockReport(AS_OF), lambda w: w.historical_max()),
    "stream_claude_dedup": _wire_query(lambda e: _usage_columns(_growing_logs(e))),
}
