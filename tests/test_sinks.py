import glob
import json
from datetime import datetime, timedelta

import pytest

from meterlake import (
    billing_blocks, block_sessions, daily, daily_by_instance, daily_detailed, monthly, sessions, weekly,
)
from meterlake.sinks.documents import block_lines, daily_detailed_lines, document_lines, write_document
from meterlake.operators.filters import UsageFilter
from meterlake.sinks.tables import read_stored, write_report, write_usage

DAY = datetime(2024, 1, 15, 10)


@pytest.fixture()
def usage(make_usage):
    return make_usage(*[
        {"ts": DAY + timedelta(hours=7 * n), "session_id": f"s{n % 3}", "input_tokens": n, "total_cost": n / 4, "instance_id": f'i"{n % 2}'}
        for n in range(12)
    ])


def read(lines):
    return json.loads("".join(r.line for r in lines.collect()))


def test_documents(usage, prices):
    reports = {
        "daily": daily(usage, prices), "daily_by_instance": daily_by_instance(usage, prices), "monthly": monthly(usage, prices),
        "weekly": weekly(usage, prices), "sessions": sessions(usage, prices),
    }
    for kind, report in reports.items():
        document = read(document_lines(report, kind))
        rows = report.collect()
        assert len(document[kind]) == len(rows)
        assert [r["tokens"]["total"] for r in document[kind]] == [r.total_tokens for r in rows]
        assert document["totals"] == {"tokens": {
            "input_tokens": 66, "output_tokens": 0, "cache_creation_tokens": 0, "cache_read_tokens": 0, "total": 66}, "total_cost": 16.5}
    first = read(document_lines(reports["sessions"], "sessions"))["sessions"][0]
    assert first["duration_seconds"] == 9 * 7 * 3600 and first["start_time"] == "2024-01-15T10:00:00+00:00"
    assert {r["instance_id"] for r in read(document_lines(reports["daily_by_instance"], "daily_by_instance"))["daily_by_instance"]} == {'i"0', 'i"1'}


def test_empty_document(usage, prices):
    document = read(document_lines(daily(usage.where("false"), prices), "daily"))
    assert document["daily"] == [] and document["totals"]["total_cost"] == 0.0


def test_daily_document_with_entries(usage, prices):
    document = read(daily_detailed_lines(daily(usage, prices), daily_detailed(usage, prices)))
    assert [len(d["entries"]) for d in document["daily"]] == [2, 4, 3, 3]
    assert [e["cost"] for d in document["daily"] for e in d["entries"]] == [n / 4 for n in range(12)]
    assert document["totals"]["total_cost"] == 16.5


def test_block_document(usage, prices):
    blocks = billing_blocks(usage, prices, "2024-01-15T11:00:00")
    document = read(block_lines(blocks, block_sessions(usage, prices)))["blocks"]
    assert [b["is_gap"] for b in document] == [False, True] * 11 + [False]
    assert [b["sessions"] for b in document if not b["is_gap"]] == [[f"s{n % 3}"] for n in range(12)]
    assert all(b["session_count"] == len(b["sessions"]) for b in document)


def test_written_document_is_the_concatenation_of_its_parts(usage, prices, tmp_path):
    path = str(tmp_path / "doc")
    write_document(document_lines(sessions(usage, prices), "sessions"), path)
    text = "".join(open(part).read() for part in sorted(glob.glob(path + "/part-*")))
    assert len(json.loads(text)["sessions"]) == 3


def test_tables(spark, usage, prices, tmp_path):
    path = str(tmp_path / "usage")
    write_usage(usage, path)
    back = spark.read.parquet(path)
    assert back.count() == 12
    assert daily(back, prices).collect() == daily(usage, prices).collect()
    chosen = UsageFilter(since="2024-01-15", until="2024-01-15")
    stored = read_stored(spark, path, chosen)
    assert sorted(map(str, stored.collect())) == sorted(map(str, chosen.apply(usage.select(*stored.columns)).collect()))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan[plan.index("PartitionFilters: ["):].split("]")[0]
    write_report(daily(usage, prices), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 4
