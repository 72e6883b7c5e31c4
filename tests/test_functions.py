from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterlake.functions import models, text
from meterlake.functions.time import parse_rfc3339, week_start, whole_minutes, zone_label


def evaluate(spark, column_of, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(column_of(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_short_names(spark):
    names = {
        "claude-opus-4-20250514": "Opus 4", "claude-opus-4-1-20250805": "Opus 4.1", "claude-opus-4-10-20250805": "Opus 4.10",
        "claude-3-opus-20240229": "Opus 3", "claude-3.5-sonnet": "Sonnet 3.5", "claude-3-opus": "Opus 3",
        "Claude-HAIKU": "Haiku", "gpt-5": "gpt-5", "claude-3.5.1-sonnet-4": "Sonnet 4", "opus": "Opus",
        "sonnet-x.y-7": "Sonnet 7", "opus-12345678": "Opus 12345678", "opus-3-": "Opus 3",
        "opus-99999999999999999999-2": "Opus 2", "opus-+4-1": "Opus +4.1", "opus-sonnet-1": "Opus 1",
    }
    assert dict(zip(names, evaluate(spark, models.short_name, *names))) == names


def test_status_names(spark):
    names = {"Claude Opus 4": "Opus", "x/y-z": "z", "plain": "plain", "my-haiku": "Haiku", "a/b": "b"}
    assert dict(zip(names, evaluate(spark, models.status_name, *names))) == names


def test_texts(spark):
    assert evaluate(spark, text.grouped, 0, 999, 1000, 1234567, kind="bigint") == ["0", "999", "1,000", "1,234,567"]
    assert evaluate(spark, text.dollars, 0.0, 1.004, 1234.5, kind="double") == ["$0.00", "$1.00", "$1234.50"]
    minute = 60_000_000
    durations = {-minute: "0m", 999_999: "0m", 59 * minute: "59m", 60 * minute: "1h 0m", 135 * minute: "2h 15m"}
    assert dict(zip(durations, evaluate(spark, text.duration, *durations, kind="bigint"))) == durations


def test_local_times(spark):
    times = [datetime(2024, 1, 15, 12, 5), datetime(2024, 7, 15, 12, 5)]
    assert evaluate(spark, lambda v: text.local_minute(v, "America/New_York"), *times, kind="timestamp") == [
        "2024-01-15 07:05 EST", "2024-07-15 08:05 EDT"]
    assert evaluate(spark, lambda v: text.local_minute(v, "UTC"), times[0], kind="timestamp") == ["2024-01-15 12:05 UTC"]
    assert evaluate(spark, lambda v: zone_label(v, "Asia/Tokyo"), times[0], kind="timestamp") == ["JST"]
    stamps = [datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 5000), datetime(2024, 1, 1, 0, 0, 0, 5)]
    assert evaluate(spark, text.rfc3339, *stamps, kind="timestamp") == [
        "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.005+00:00", "2024-01-01T00:00:00.000005+00:00"]


@pytest.mark.parametrize("value, valid", [
    ("2024-01-15T10:00:00Z", True), ("2024-01-15t10:00:00z", True), ("2024-01-15 10:00:00.1234567+05:30", True),
    ("2024-01-15T10:00:00", False), ("2024-01-15", False), ("2024-13-15T10:00:00Z", False), ("2024-01-15T25:00:00Z", False),
    ("2024-01-15T10:00:00+0530", False), ("", False), (None, False), (" 2024-01-15T10:00:00Z", False),
])
def test_rfc3339(spark, value, valid):
    assert (evaluate(spark, parse_rfc3339, value)[0] is not None) == valid


def test_whole_units_and_weeks(spark):
    assert evaluate(spark, whole_minutes, -61_000_000, 59_999_999, 60_000_000, kind="bigint") == [-1, 0, 1]
    assert str(evaluate(spark, lambda v: week_start(v, 3), datetime(2024, 1, 16).date(), kind="date")[0]) == "2024-01-10"
