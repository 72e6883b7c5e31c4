import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake import (
    billing_blocks, block_projects, block_sessions, blocks_from_sessions, filter_blocks, sessions, with_token_warnings,
)
from meterlake.functions.args import duration_micros, parse_token_limit
from meterlake.operators.blocks import BlockRule, fold_units
from tests import brute

DAY = datetime(2024, 1, 15)
LATER = "2030-01-01T00:00:00"


def at(hours, **more):
    return {"ts": DAY + timedelta(hours=hours), **more}


def spans(rows):
    return [(r.start_time, r.end_time, r.is_gap, r.input_tokens) for r in rows]


def test_block_and_gap(make_usage, prices):
    usage = make_usage(
        at(10.5, input_tokens=100), at(13.5, input_tokens=200), at(19.5, input_tokens=150, model="claude-3-sonnet"))
    rows = billing_blocks(usage, prices, LATER).orderBy("start_time").collect()
    assert spans(rows) == [
        (DAY + timedelta(hours=10), DAY + timedelta(hours=15), False, 300),
        (DAY + timedelta(hours=18.5), DAY + timedelta(hours=19.5), True, 0),
        (DAY + timedelta(hours=19), DAY + timedelta(hours=24), False, 150),
    ]
    assert rows[0].actual_end_time == DAY + timedelta(hours=13.5)
    assert (rows[1].models_used, rows[1].session_count, rows[1].total_cost) == ([], 0, 0.0)


def test_boundaries_are_strict(make_usage, prices):
    usage = make_usage(*[at(h) for h in (0, 2, 4, 5, 7, 9, 10, 12, 14, 15, 17, 19, 20, 22)])
    rows = billing_blocks(usage, prices, LATER).orderBy("start_time").collect()
    assert [r.start_time.hour for r in rows] == [0, 7, 14, 20] and not any(r.is_gap for r in rows)


def test_activity(make_usage, prices):
    one = make_usage(at(10))
    assert billing_blocks(one, prices, "2024-01-15T12:00:00").first().is_active
    assert not billing_blocks(one, prices, "2024-01-15T14:00:00", hours=2).first().is_active
    late = make_usage(at(10.9))
    assert not billing_blocks(late, prices, "2024-01-15T15:00:00").first().is_active
    assert billing_blocks(late, prices, "2024-01-15T14:59:59").first().is_active


@pytest.mark.parametrize("hours", [5, 1, 2.5, 1.25, 24, 0.5, 0.25, 0])
def test_random_timelines_equal_the_walk(make_usage, prices, hours):
    rng = random.Random(int(hours * 100))
    times = {}
    for user in ("a", "b", None):
        moments, now = [], DAY
        for _ in range(120):
            now += timedelta(minutes=rng.choice([0, 0, 1, 7, 30, 60, 61, 300, 301, 900]), seconds=rng.choice([0, 0, 1]))
            moments.append(now)
        times[user] = moments
    rows = [{"ts": t, "project": user, "input_tokens": 1} for user, moments in times.items() for t in moments]
    rng.shuffle(rows)
    found = billing_blocks(make_usage(*rows), prices, LATER, hours=hours, keys=["project"]).collect()
    length = timedelta(hours=hours)
    for user, moments in times.items():
        blocks, gaps = brute.blocks(moments, hours)
        mine = [r for r in found if r.project == user]
        assert sorted((r.start_time, r.actual_start_time, r.actual_end_time, r.input_tokens) for r in mine if not r.is_gap) == sorted(blocks)
        assert sorted((r.start_time, r.end_time) for r in mine if r.is_gap) == sorted(gaps)
        assert all(r.end_time == r.start_time + length for r in mine if not r.is_gap)


def test_global_timeline_equals_the_walk(make_usage, prices):
    rng = random.Random(3)
    times = [DAY + timedelta(minutes=rng.randint(0, 60 * 24 * 40)) for _ in range(150)]
    found = billing_blocks(make_usage(*[{"ts": t, "input_tokens": 1} for t in times]), prices, LATER).collect()
    blocks, gaps = brute.blocks(times, 5)
    assert sorted((r.start_time, r.actual_start_time, r.actual_end_time, r.input_tokens) for r in found if not r.is_gap) == blocks
    assert sorted((r.start_time, r.end_time) for r in found if r.is_gap) == gaps
    assert sum(r.input_tokens for r in found) == len(times)


def test_times_before_1970(make_usage, prices):
    usage = make_usage({"ts": datetime(1969, 12, 31, 20, 30)}, {"ts": datetime(1970, 1, 1, 1, 30)}, {"ts": datetime(1970, 1, 1, 1, 31)})
    rows = billing_blocks(usage, prices, LATER).orderBy("start_time").collect()
    assert [r.start_time for r in rows] == [datetime(1969, 12, 31, 20), datetime(1970, 1, 1, 1)]


def test_block_sessions(make_usage, prices):
    usage = make_usage(
        at(1, session_id="s1", model="b"), at(2, session_id="s1", model="a"), at(3, session_id="s1", model="a"),
        at(1.5, session_id="s2", model="y"), at(1.6, session_id="s2", model="x"), at(8, session_id="s1", model="b"),
    )
    rows = block_sessions(usage, prices).orderBy("block_start", "start_time").collect()
    assert [(r.block_start.hour, r.session_id, r.model) for r in rows] == [(1, "s1", "a"), (1, "s2", "x"), (8, "s1", "b")]
    assert rows[0].end_time == DAY + timedelta(hours=3)


def test_blocks_from_sessions(make_usage, prices):
    usage = make_usage(
        at(0.5, session_id="a", input_tokens=1), at(30, session_id="a", input_tokens=1),
        at(4.9, session_id="b", input_tokens=1), at(5, session_id="c", input_tokens=1, model="claude-2"),
    )
    rows = blocks_from_sessions(sessions(usage, prices), "2024-01-15T09:00:00").orderBy("start_time").collect()
    assert [(r.start_time.hour, r.session_count, r.input_tokens, r.is_active) for r in rows] == [(0, 2, 3, False), (5, 1, 1, True)]
    assert rows[0].actual_end_time == DAY + timedelta(hours=4.9)
    assert rows[1].models_used == ["claude-2"] and rows[1].projects_used == []


def test_filters(make_usage, prices):
    usage = make_usage(
        at(1, project="a", input_tokens=1), at(2, project="b", input_tokens=2), at(25, input_tokens=4), at(49, project="b", input_tokens=8))
    now = "2024-01-17T03:00:00"
    blocks = billing_blocks(usage, prices, now)

    def tokens(**kwargs):
        return sorted(r.input_tokens for r in filter_blocks(blocks, now, **kwargs).collect() if not r.is_gap)

    assert tokens() == [3, 4, 8]
    assert tokens(project="b") == [3, 8]
    assert tokens(since="2024-01-16") == [4, 8]
    assert tokens(until="2024-01-15") == [3]
    assert tokens(active=True) == [8]
    assert tokens(recent=True) == [8]
    assert filter_blocks(blocks, now, project="b").where("is_gap").count() == 0


def test_token_warnings(make_usage, prices):
    usage = make_usage(at(1, input_tokens=100), at(9, input_tokens=80), at(17, input_tokens=79))
    blocks = billing_blocks(usage, prices, LATER)

    def warnings(limit, *budget):
        return [r.warning for r in with_token_warnings(blocks, limit, *budget).where("not is_gap").orderBy("start_time").collect()]

    assert warnings("100") == [
        "⚠️  Block has used 100 tokens, exceeding threshold of 100 tokens",
        "⚠️  Block approaching limit: 80 tokens used (80% of threshold)",
        None,
    ]
    assert warnings("50%", 200.0)[0] == "⚠️  Block has used 100 tokens, exceeding threshold of 50% (~100 tokens)"
    assert None not in warnings("0")
    for bad in ("many", "x%", "-5", "1.5", ""):
        with pytest.raises(ValueError):
            parse_token_limit(bad, 1.0)


def test_durations():
    assert duration_micros(2.5) == 9_000_000_000
    for bad in (-1.0, -0.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            duration_micros(bad)


def test_blocks_of_sessions_last_whole_hours(make_usage, prices):
    usage = make_usage()
    for hours in (2.5, 0.5, 0):
        with pytest.raises(ValueError):
            blocks_from_sessions(sessions(usage, prices), "2024-01-15T09:00:00", hours)


def test_many_blocks_in_one_timeline(spark):
    """Positions of openers are noted in parts; every second hour opens a block."""
    units = spark.range(3000).selectExpr("id * 4 AS _unit")
    rows = fold_units(units, BlockRule(1.0)).collect()
    assert sorted((r["_start_hour"], r["_unit"]) for r in rows) == [(2 * k, 4 * k) for k in range(3000)]


@pytest.mark.parametrize("keys", [(), ("session_id",), ("project",)])
def test_projects_as_rows(spark, prices, make_usage, keys):
    """Rows and sets say the same, and the filter by rows keeps the same blocks."""
    usage = make_usage(*[
        {"ts": DAY + timedelta(minutes=97 * i % 9000), "session_id": f"s{i % 3}", "project": f"p{i % 5}" if i % 4 else None, "input_tokens": i}
        for i in range(120)])
    now = LATER
    blocks = billing_blocks(usage, prices, now, keys=keys).cache()
    rows = block_projects(usage, keys=keys).cache()
    shared = [k for k in keys if k != "project"]
    sets = blocks.where("NOT is_gap").select(*shared, F.col("start_time").alias("block_start"), F.explode("projects_used").alias("project"))
    assert sorted(map(tuple, sets.distinct().collect())) == sorted(map(tuple, rows.select(sets.columns).collect()))
    slim = billing_blocks(usage, prices, now, keys=keys, project_sets=False)
    assert {r["projects_used"] for r in slim.collect()} == {None}
    wanted = filter_blocks(blocks, now, project="p3").drop("projects_used")
    got = filter_blocks(slim, now, project="p3", projects=rows).drop("projects_used")
    assert wanted.count() and sorted(map(repr, wanted.collect())) == sorted(map(repr, got.collect()))
    with pytest.raises(ValueError):
        block_projects(usage, hours=0.5)
