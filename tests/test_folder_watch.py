"""A watched folder gives the batch result for files that grow, change, go and arrive in any order."""

import os

import pytest

from meterlake import BlockReport, read_usage
from meterlake.streaming import folder as watch
from meterlake.streaming.folder import merge, refresh, watched_usage
from tests.conftest import claude_line


def line(minute, cost=None, **more):
    return claude_line(f"2024-01-15T10:{minute:02d}:00Z", sessionId="s", costUSD=cost, **more)


def rows(usage):
    return sorted(tuple(r) for r in usage.select("_file", "_ord", "ts", "input_tokens", "total_cost").collect())


@pytest.fixture()
def table(tmp_path):
    return str(tmp_path / "table")


def same_as_batch(spark, root, table):
    batch = rows(read_usage(spark, "claude", root))
    assert rows(watched_usage(spark, table)) == batch
    return batch


def test_nothing_there(spark, tmp_path, table):
    assert not refresh(spark, str(tmp_path / "none"), table)
    assert watched_usage(spark, table).count() == 0


def test_appended_changed_and_removed_files(spark, put, table):
    root = put("logs/p/a.jsonl", line(1), line(2)) + "/logs"
    put("logs/q/b.jsonl", line(3))
    assert refresh(spark, root, table)
    assert not refresh(spark, root, table)
    assert len(same_as_batch(spark, root, table)) == 3
    put("logs/p/a.jsonl", line(1), line(2), line(4))
    assert refresh(spark, root, table)
    assert len(same_as_batch(spark, root, table)) == 4
    os.remove(f"{root}/q/b.jsonl")
    put("logs/p/a.jsonl", line(5))
    assert refresh(spark, root, table)
    assert len(same_as_batch(spark, root, table)) == 1


def test_first_by_name_wins_though_it_comes_later(spark, put, table):
    root = put("logs/b.jsonl", line(1, 9.0, mid="m", rid="r"), line(2), line(2)) + "/logs"
    refresh(spark, root, table)
    put("logs/a.jsonl", line(1, 1.0, mid="m", rid="r"))
    refresh(spark, root, table)
    assert [r[4] for r in same_as_batch(spark, root, table)] == [1.0, None, None]


def test_an_old_file_moved_in_is_seen(spark, put, table):
    root = put("logs/a.jsonl", line(1)) + "/logs"
    refresh(spark, root, table)
    put("logs/old.jsonl", line(2))
    os.utime(f"{root}/old.jsonl", (1_600_000_000, 1_600_000_000))
    assert refresh(spark, root, table)
    assert len(same_as_batch(spark, root, table)) == 2


def test_blocks_below_an_hour(spark, put, table, prices):
    root = put("logs/a.jsonl", line(50), line(52), line(54)) + "/logs"
    refresh(spark, root, table)
    assert BlockReport("2024-01-16T00:00:00Z", hours=0.25).run(watched_usage(spark, table), prices).count() == 3


def test_merge_bounds_the_folders(spark, put, tmp_path, table):
    for n in range(1, 4):
        root = put("logs/a.jsonl", *[line(m) for m in range(n)]) + "/logs"
        assert refresh(spark, root, table, merge_after=1)
        assert len(same_as_batch(spark, root, table)) == n
    assert max(len(list((tmp_path / "table" / part).glob("version=*"))) for part in ("commits", "files", "records")) <= 3


@pytest.mark.parametrize("step", ["_commit", "remove_folder"])
def test_crash_while_merging(spark, put, table, monkeypatch, step):
    root = put("logs/a.jsonl", line(1)) + "/logs"
    refresh(spark, root, table)
    put("logs/b.jsonl", line(2))
    refresh(spark, root, table)

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as patch:
        patch.setattr(watch, step, crash)
        with pytest.raises(RuntimeError):
            merge(spark, table)
    assert len(same_as_batch(spark, root, table)) == 2
    put("logs/c.jsonl", line(3))
    assert refresh(spark, root, table)
    merge(spark, table)
    assert len(same_as_batch(spark, root, table)) == 3
