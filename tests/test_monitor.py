from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake import active_sessions, billing_blocks, historical_max, spend_snapshot, with_burn_rate
from meterlake.operators.monitor import budget_band, burn_status, projection_status, time_left, time_left_text
from meterlake.sinks.display import with_block_texts, with_display_columns

DAY = datetime(2024, 1, 15)


def at(hours, **more):
    return {"ts": DAY + timedelta(hours=hours), **more}


@pytest.fixture()
def usage(make_usage):
    return make_usage(at(-24, total_cost=40.0), at(10.5, total_cost=6.0), at(11.5, total_cost=4.0, session_id="t"))


def test_burn_rate(usage, prices):
    now = "2024-01-15T12:00:30"
    blocks = billing_blocks(usage, prices, now)
    row = with_burn_rate(blocks.where("is_active"), blocks, now).first()
    assert (row.total_cost, row.max_cost, row.remaining_minutes) == (10.0, 40.0, 179)
    assert row.burn_rate == pytest.approx(10.0 / 120)
    assert row.projected_cost == pytest.approx(10.0 + 10.0 / 120 * 179)
    assert row.usage_percent == pytest.approx(25.0)
    assert row.block_progress == pytest.approx(7230 / 18000 * 100)
    assert (row.projection_status, row.burn_status) == ("WITHIN LIMITS", "NORMAL")
    capped = with_burn_rate(blocks.where("is_active"), blocks, now, user_max=20.0).first()
    assert (capped.max_cost, capped.projection_status) == (20.0, "WILL EXCEED LIMIT")


def test_burn_rate_below_a_minute(make_usage, prices):
    now = "2024-01-15T10:00:30"
    blocks = billing_blocks(make_usage(at(10, total_cost=1.0)), prices, now)
    row = with_burn_rate(blocks, blocks, now).first()
    assert row.burn_rate == pytest.approx(2.0) and row.burn_status == "HIGH"


def test_historical_max(spark, usage, make_usage, prices):
    assert historical_max(billing_blocks(usage, prices, "2024-01-15T12:00:00")).first()[0] == 40.0
    free = billing_blocks(make_usage(at(1)), prices, "2024-01-15T12:00:00")
    assert historical_max(free).first()[0] == 50.0
    assert historical_max(free.where(F.lit(False))).first()[0] == 50.0
    assert historical_max(free, 7).first()[0] == 7.0


def test_active_sessions(make_usage):
    entries = make_usage(*[at(12 - m / 60, session_id=s) for m, s in [(0, "a"), (1, "a"), (4.9, "b"), (5, "c"), (60, "d")]])
    rows = active_sessions(entries, "2024-01-15T12:00:00").orderBy("session_id").collect()
    assert [(r.session_id, r.entries) for r in rows] == [("a", 2), ("b", 1)]


def test_spend_snapshot(spark, make_usage, prices):
    entries = make_usage(
        at(-10, session_id="a", total_cost=1.0), at(10.25, session_id="a", total_cost=2.0),
        at(11, session_id="b", total_cost=4.0), at(2, session_id="b", total_cost=8.0))
    requests = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "session_id string")
    rows = spend_snapshot(entries, requests, prices, "2024-01-15T12:00:00", 310.0, "America/New_York").orderBy("session_id").collect()
    assert [(r.session_id, r.session_cost, r.time_left) for r in rows] == [
        ("a", 3.0, "expired"), ("b", 12.0, "expired"), ("c", 0.0, "no block")]
    assert {r.day_cost for r in rows} == {6.0}
    assert rows[0].budget_percent == pytest.approx(60.0) and rows[0].budget_band == "good"
    assert rows[0].cost_text == "$3.00" and rows[2].cost_text == "no session"


def test_time_left(spark):
    starts = spark.createDataFrame([(DAY + timedelta(hours=h),) for h in (12.5, 13.9, 9, 15, 10.1)], "s timestamp")
    now = "2024-01-15T14:30:00"
    rows = starts.select(time_left(F.col("s"), now).alias("left"), time_left_text(F.col("s"), now).alias("text")).collect()
    assert [None if r.left is None else r.left // 60_000_000 for r in rows] == [150, 210, None, None, 30]
    assert [r.text for r in rows] == ["2h 30m left", "3h 30m left", "expired", "no block", "30m left"]


def test_classifications(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.2, 0.21, 0.51, 79.9, 80.0, 80.1, 100.1, 120.0, 150.0)], "v double")
    rows = df.select(projection_status(F.col("v")), burn_status(F.col("v")), budget_band(F.col("v"))).collect()
    assert [r[0].split()[0] for r in rows] == ["WITHIN"] * 6 + ["APPROACHING"] + ["WILL"] * 3
    assert [r[1] for r in rows] == ["NORMAL"] * 2 + ["ELEVATED"] + ["HIGH"] * 7
    assert [r[2] for r in rows] == ["muted"] + ["good"] * 4 + ["warn"] * 3 + ["over", "high"]


def test_block_texts(make_usage, prices):
    entries = make_usage(at(0), at(1.5), at(10.25, input_tokens=1234))
    blocks = billing_blocks(entries, prices, "2024-01-15T12:00:00")
    rows = with_block_texts(with_display_columns(blocks), "2024-01-15T12:00:00", "America/New_York").orderBy("start_time").collect()
    assert [(r.status, r.time_remaining, r.start_text) for r in rows] == [
        ("Complete", "-", "2024-01-14 19:00 EST (1h 30m)"),
        ("GAP", "-", "2024-01-15 01:30 EST - 2024-01-15 05:15 EST (3h 45m gap)"),
        ("ACTIVE", "3h 0m", "2024-01-15 05:00 EST (2h 0m elapsed)"),
    ]
    assert (rows[2].input_tokens_text, rows[2].models_text) == ("1,234", "Opus 3")
