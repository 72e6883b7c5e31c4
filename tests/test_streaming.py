"""Streaming results equal the batch results over the same files."""

import shutil

import pytest
from pyspark.sql import functions as F

from meterlake import (
    BlockReport, daily_by_instance_report, daily_report, default_prices, monthly_report, read_usage, session_report, weekly_report,
)
from meterlake.operators.meters import METERS, merge_meters
from meterlake.streaming.live import read_meters, running_sums, start_watch, stream_usage
from tests.conftest import claude_line

AS_OF = "2024-02-10T00:00:00"
REPORTS = {
    "daily": daily_report("America/New_York"),
    "by_instance": daily_by_instance_report(),
    "monthly": monthly_report(),
    "weekly": weekly_report(start_of_week="monday"),
    "sessions": session_report(),
    "blocks": BlockReport(AS_OF),
}


def log(first, last):
    """Lines of one file; every third one repeats an id of the line before, some have no id."""
    lines = []
    for n in range(first, last):
        ids = {} if n % 5 == 0 else {"mid": f"m{n - (n % 3 == 1)}", "rid": "r"}
        lines.append(claude_line(
            f"2024-01-{1 + n % 28:02d}T{n % 24:02d}:15:00Z", model=f"claude-3-{['opus', 'haiku'][n % 2]}",
            tokens=(10, 2, 1, 0), sessionId=f"s{n % 4}", uuid=f"u{n % 3}", cwd=f"/p{n % 2}", **ids))
    return lines


def comparable(report):
    order = [c for c in report.columns if c not in ("models_used", "projects_used")]
    return [tuple(r) for r in report.orderBy(*order).collect()]


def test_watch_equals_batch_and_takes_late_files(spark, put, tmp_path, prices):
    root = put("logs/a.jsonl", *log(0, 60)) + "/logs"
    folder = tmp_path / "watch"
    refreshed = []

    def run(name):
        usage = stream_usage(spark, root, max_files_per_trigger=1)
        start_watch(
            usage, REPORTS[name], f"{folder}/{name}/meters", f"{folder}/{name}/checkpoint",
            lambda meters, batch: refreshed.append((name, batch))).awaitTermination()
        return REPORTS[name].from_meters(read_meters(spark, f"{folder}/{name}/meters"), prices)

    for name in ("sessions", "blocks"):
        run(name)
    put("logs/b.jsonl", *log(40, 90))
    put("logs/c.jsonl", *log(0, 20), "broken")
    batch = read_usage(spark, "claude", root)
    for name, report in REPORTS.items():
        assert comparable(run(name)) == comparable(report.run(batch, prices)), name
    assert {batch for name, batch in refreshed if name == "sessions"} == {0, 1, 2}


def test_restart_does_not_count_twice(spark, put, tmp_path, prices):
    root = put("logs/a.jsonl", *log(0, 30)) + "/logs"
    report, table, checkpoint = REPORTS["daily"], str(tmp_path / "meters"), str(tmp_path / "checkpoint")
    for _ in range(2):
        start_watch(stream_usage(spark, root), report, table, checkpoint).awaitTermination()
    expected = comparable(report.run(read_usage(spark, "claude", root), prices))
    assert comparable(report.from_meters(read_meters(spark, table), prices)) == expected
    # A replay of the last batch overwrites its folder.
    shutil.rmtree(tmp_path / "checkpoint" / "commits")
    start_watch(stream_usage(spark, root), report, table, checkpoint).awaitTermination()
    assert comparable(report.from_meters(read_meters(spark, table), prices)) == expected


def test_merged_meters_give_the_same_report(spark, put, prices):
    usage = read_usage(spark, "claude", put("a.jsonl", *log(0, 80)))
    for report in (REPORTS["sessions"], REPORTS["blocks"]):
        halves = report.compact(usage.where("_ord % 3 = 0")).unionByName(report.compact(usage.where("_ord % 3 > 0")))
        merged = merge_meters(halves)
        assert merged.count() == halves.select(*[c for c in halves.columns if c not in METERS]).distinct().count()
        assert comparable(report.from_meters(merged, prices)) == comparable(report.run(usage, prices))


def test_watermark_dedup(spark, put, tmp_path):
    root = put("logs/a.jsonl", *log(0, 60)) + "/logs"
    stream = stream_usage(spark, root, watermark="60 days")
    query = stream.writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("deduped").count() == read_usage(spark, "claude", root).count()


def test_running_sums(spark, put):
    root = put("logs/a.jsonl", *log(0, 60)) + "/logs"
    sums = running_sums(stream_usage(spark, root), session_id="session_id")
    query = sums.writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    mine = spark.table("sums").groupBy("session_id").agg(F.sum("input_tokens")).collect()
    batch = read_usage(spark, "claude", root).groupBy("session_id").agg(F.sum("input_tokens")).collect()
    assert sorted(mine) == sorted(batch)
