"""Reports, filters and their path rules on small inputs with known answers."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake import (
    MonthFilter, UsageFilter, daily, daily_by_instance, daily_detailed, monthly, monthly_bits_report, monthly_report, other_provider_report,
    primary_provider_report, read_usage, sessions, totals, weekly, weekly_bits_report,
    weekly_report, with_totals,
)
from meterlake.functions.args import parse_date, parse_instant, parse_weekday, parse_zone
from meterlake.operators.meters import merge_meters
from meterlake.schemas import TOKENS
from tests.conftest import claude_line


def at(text):
    return datetime.fromisoformat(text)


@pytest.fixture()
def parity(make_usage):
    """Three entries of one day in two sessions."""
    def entry(ts, session, model, tokens, cost):
        return {"ts": at(ts), "session_id": session, "model": model, "total_cost": cost, **dict(zip(TOKENS, tokens))}

    return make_usage(
        entry("2024-01-15T10:00:00", "s1", "claude-3-opus", (1000, 500, 100, 50), 0.0255),
        entry("2024-01-15T10:30:00", "s1", "claude-3-opus", (2000, 1000, 200, 100), 0.051),
        entry("2024-01-15T14:00:00", "s2", "claude-3-sonnet", (500, 250, 50, 25), 0.00375),
    )


def test_parity_day(parity, prices):
    row = daily(parity, prices).first()
    assert (row.date, row.input_tokens, row.output_tokens) == (date(2024, 1, 15), 3500, 1750)
    assert row.total_cost == pytest.approx(0.08025)
    assert row.total_tokens == 3500 + 1750 + 350 + 175
    assert row.models_used == ["claude-3-opus", "claude-3-sonnet"]
    assert sessions(parity, prices).count() == 2


def test_sessions(parity, prices):
    first, second = sessions(parity, prices).collect()
    assert (first.session_id, first.start_time, first.end_time) == ("s1", at("2024-01-15T10:00:00"), at("2024-01-15T10:30:00"))
    assert (second.model, second.total_cost) == ("claude-3-sonnet", 0.00375)


def test_session_model_is_that_of_the_first_entry(make_usage, prices):
    same = at("2024-01-15T10:00:00")
    usage = make_usage(
        {"ts": same + timedelta(hours=1), "model": "a", "_ord": 0},
        {"ts": same, "model": "z", "_ord": 1},
        {"ts": same, "model": "b", "_ord": 2},
    )
    assert sessions(usage, prices).first().model == "z"


def test_daily_by_instance(make_usage, prices):
    day = {"ts": at("2024-01-15T10:00:00"), "input_tokens": 1}
    usage = make_usage({**day, "instance_id": "x"}, day, {**day, "instance_id": "x"}, {**day, "ts": at("2024-01-16T00:00:00")})
    rows = daily_by_instance(usage, prices).collect()
    assert [(str(r.date), r.instance_id, r.input_tokens) for r in rows] == [
        ("2024-01-15", "default", 1), ("2024-01-15", "x", 2), ("2024-01-16", "default", 1),
    ]


def test_local_dates(make_usage, prices):
    usage = make_usage({"ts": at("2024-01-16T02:00:00"), "input_tokens": 5}, {"ts": at("2024-07-16T03:59:00"), "input_tokens": 6})
    assert [str(r.date) for r in daily(usage, prices, tz="America/New_York").collect()] == ["2024-01-15", "2024-07-15"]
    assert [str(r.date) for r in daily(usage, prices, tz="Asia/Tokyo").collect()] == ["2024-01-16", "2024-07-16"]


def test_monthly_and_active_days(make_usage, prices):
    stamps = ["2024-01-31T23:00:00", "2024-01-31T01:00:00", "2024-01-02T00:00:00", "2024-02-01T00:00:00"]
    usage = make_usage(*[{"ts": at(s), "input_tokens": 1} for s in stamps])
    assert [(r.month, r.input_tokens, r.active_days) for r in monthly(usage, prices).collect()] == [
        ("2024-01", 3, 2), ("2024-02", 1, 1),
    ]
    chosen = monthly(usage, prices, months=MonthFilter("2024-02-17", "2024-02"))
    assert [r.month for r in chosen.collect()] == ["2024-02"]


@pytest.mark.parametrize("start", ["sunday", "monday", "wednesday", "saturday"])
def test_week_starts(make_usage, prices, start):
    days = [date(2023, 12, 25) + timedelta(days=n) for n in range(21)]
    usage = make_usage(*[{"ts": datetime(d.year, d.month, d.day, 12), "input_tokens": 1} for d in days])
    expected = {}
    for d in days:
        first = d - timedelta(days=((d.isoweekday() % 7) - parse_weekday(start) + 7) % 7)
        expected[first] = expected.get(first, 0) + 1
    rows = weekly(usage, prices, start_of_week=start).collect()
    assert {r.week: r.active_days for r in rows} == expected
    january = weekly(usage, prices, start_of_week=start, months=MonthFilter(since="2024-01")).collect()
    assert [r.week for r in january] == sorted(w for w in expected if w >= date(2024, 1, 1))


def test_filters(make_usage, prices):
    usage = make_usage(*[
        {"ts": at("2024-01-10T00:00:00") + timedelta(hours=6 * n), "input_tokens": 1, "project": [None, "a", "b"][n % 3]}
        for n in range(40)
    ])
    rows = [(r.ts, r.project) for r in usage.collect()]
    for tz, shift in (("UTC", 0), ("Asia/Tokyo", 9), ("America/New_York", -5)):
        for project in (None, "a"):
            chosen = UsageFilter("2024-01-12", "2024-01-14", project, tz).apply(usage).collect()
            expected = [
                r for r in rows
                if date(2024, 1, 12) <= (r[0] + timedelta(hours=shift)).date() <= date(2024, 1, 14)
                and (project is None or r[1] == project)
            ]
            assert sorted((r.ts, r.project or "") for r in chosen) == sorted((t, p or "") for t, p in expected)


def test_date_filter_reaches_the_scan(spark, make_usage, tmp_path):
    make_usage({"ts": at("2024-01-10T00:00:00")}).write.parquet(str(tmp_path / "u"))
    chosen = UsageFilter("2024-01-12", "2024-01-14", tz="Asia/Tokyo").apply(spark.read.parquet(str(tmp_path / "u"))).select("model")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-11" in plan and "LessThan(ts,2024-01-16" in plan
    assert "input_tokens" not in plan


def test_path_rules(make_usage, prices):
    usage = make_usage(*[
        {"ts": datetime(2024, 1, d, 12), "input_tokens": 1, "project": "a" if d % 2 else "b"} for d in range(1, 31)
    ])
    chosen = UsageFilter("2024-01-10", "2024-01-20", "a")
    primary = primary_provider_report(usage, prices, "monthly", usage_filter=chosen).first()
    other = other_provider_report(usage, prices, "monthly", usage_filter=chosen).first()
    assert (primary.input_tokens, primary.active_days) == (30, 30)
    assert (other.input_tokens, other.active_days) == (5, 5)
    assert other_provider_report(usage, prices, "daily_detailed", usage_filter=chosen).count() == 5
    with pytest.raises(ValueError):
        other_provider_report(usage, prices, "yearly")


def test_totals_equal_sum_of_rows(parity, prices):
    for report in (daily(parity, prices), sessions(parity, prices), monthly(parity, prices)):
        total = totals(report).first()
        assert total.total_tokens == sum(r.total_tokens for r in report.collect())
        assert total.total_cost == pytest.approx(0.08025)
    both = with_totals(daily(parity, prices), "date").collect()
    assert sorted((r.date is None, r.input_tokens) for r in both) == [(False, 3500), (True, 3500)]
    nothing = totals(daily(parity.where(F.lit(False)), prices)).first()
    assert (nothing.total_tokens, nothing.total_cost) == (0, 0.0)


def test_daily_detailed(parity, prices):
    rows = daily_detailed(parity, prices).orderBy("timestamp").collect()
    assert [r.cost for r in rows] == [0.0255, 0.051, 0.00375]
    assert [r.total_tokens for r in rows] == [1650, 3300, 825]


def test_month_of_growing_usage(spark, put, prices):
    """31 days x 3 sessions, tokens grow by 10 % of the base per day."""
    lines = []
    for d in range(31):
        for s in range(3):
            base = 1000 + 100 * d
            lines.append(claude_line(f"2024-01-{d + 1:02d}T1{s}:00:00Z", tokens=(base, base // 2, 0, 0), sessionId=f"s{d}-{s}"))
    usage = read_usage(spark, "claude", put("month.jsonl", *lines))
    rows = daily(usage, prices).collect()
    assert usage.count() == 93 and len(rows) == 31
    assert [r.input_tokens for r in rows] == [3 * (1000 + 100 * d) for d in range(31)]


def test_plan_sums_before_it_shuffles(parity, prices):
    """Only sums per day and model are exchanged; the date filter and the lookup see no raw entries."""
    plan = daily(parity, prices)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_arguments():
    assert parse_date("2024-02") == date(2024, 2, 1)
    assert parse_date("2024-02-29") == date(2024, 2, 29)
    for bad in ("2023-02-29", "2024-13", "yesterday", "2024", "2024/01/01"):
        with pytest.raises(ValueError):
            parse_date(bad)
    assert (parse_weekday("SUN"), parse_weekday("Saturday")) == (0, 6)
    with pytest.raises(ValueError):
        parse_weekday("noday")
    assert parse_zone(None) == "UTC"
    with pytest.raises(ValueError):
        parse_zone("Mars/Olympus")
    assert parse_instant("2024-01-01T02:00:00+02:00") == parse_instant("2024-01-01T00:00:00")


def test_day_bits_equal_distinct_days(spark, prices, make_usage):
    """Bits of overlapping batches add up to the days; each batch and the whole have a row per period and model only."""
    base = datetime(2024, 1, 28, 3)
    usage = make_usage(*[{"ts": base + timedelta(hours=(7 * i) % 1700), "model": f"claude-{2 + i % 2}", "input_tokens": i} for i in range(90)])
    for bits, days in [
        (monthly_bits_report("America/New_York"), monthly_report("America/New_York")),
        (weekly_bits_report("UTC", "wednesday"), weekly_report("UTC", "wednesday")),
    ]:
        first, rest = usage.where("_ord % 3 = 0"), usage.where("_ord % 3 <> 0")
        merged = merge_meters(bits.compact(first).unionByName(bits.compact(rest)))
        wanted = days.run(usage, prices).collect()
        assert bits.from_meters(merged, prices).collect() == wanted == bits.run(usage, prices).collect()
        assert merged.count() <= 2 * len(wanted)
        with pytest.raises(ValueError):
            bits.compact_changes(usage.withColumn("sign", F.lit(1)))
