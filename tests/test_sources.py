"""Readers of the five log formats, on small files with known answers."""

import json
import os
from datetime import datetime, timezone

import pytest

from meterlake.demo import wire
from meterlake.schemas import TOKENS, USAGE_COLUMNS
from meterlake.session import subfolders
from meterlake.sources import PROVIDERS, claude, read_usage, skipped_lines, union_usage
from meterlake.sources.lines import read_lines
from tests.conftest import claude_line


def tokens(row):
    return tuple(row[name] for name in TOKENS)


def test_claude_fields(spark, put):
    root = put(
        "a/b/log.jsonl",
        claude_line(tokens=(1000, 500, 100, 50), sessionId="s1", costUSD=0.5, cost_usd=0.7, cwd="/home/u/my-project/",
                    uuid="not-a-uuid", type="assistant", mid="m", rid="r"),
        claude_line(ts="2024-01-15T12:00:00.123456789+02:00", cost_usd=0.7, cwd="/"),
    )
    first, second = read_usage(spark, "claude", root).orderBy("_ord").collect()
    assert (first.session_id, first.project, first.instance_id, first.total_cost) == ("s1", "my-project", "not-a-uuid", 0.5)
    assert tokens(first) == (1000, 500, 100, 50)
    assert second.session_id == "generated-1705312800-claude-3-opus"
    assert second.ts == datetime(2024, 1, 15, 10, 0, 0, 123456)
    assert (second.project, second.total_cost) == (None, 0.7)


@pytest.mark.parametrize("cwd, project", [
    ("/a/b", "b"), ("/a/b/", "b"), ("/a/b/.", "b"), ("b", "b"), ("/", None), ("/a/..", None), (".", None), ("", None), (None, None),
])
def test_project_is_last_path_component(spark, cwd, project):
    row = spark.createDataFrame([(cwd,)], "cwd string")
    assert row.select(claude.last_component(row.cwd)).first()[0] == project


def test_claude_skips_invalid_records(spark, put):
    root = put(
        "log.jsonl",
        "not json", "", "   ", "[1, 2]", "null",
        {"timestamp": "2024-01-15T10:00:00Z"},
        {"timestamp": "2024-01-15T10:00:00Z", "message": {"model": "m", "usage": {"output_tokens": 3}}},
        claude_line(type="user"),
        claude_line(ts="2024-01-15"),
        claude_line(ts="2024-01-15T10:00:00"),
        claude_line(ts="invalid"),
        claude_line(model="<synthetic>"),
        claude_line(isApiErrorMessage=True),
        claude_line(tokens=(-5, 1, 0, 0)),
        claude_line(tokens=("5", 1, 0, 0)),
        claude_line(tokens=(1.5, 1, 0, 0)),
        claude_line(sessionId="kept", isApiErrorMessage=False),
        claude_line(sessionId="no tokens is fine", tokens=(0, 0, 0, 0)),
    )
    assert sorted(r.session_id for r in read_usage(spark, "claude", root).collect()) == ["kept", "no tokens is fine"]
    counts = skipped_lines(read_lines(spark, root, "*.jsonl", True), claude.RECORD).first()
    assert (counts.lines, counts.skipped) == (16, 5)


def test_claude_default_token_counts(spark, put):
    root = put("x.jsonl", {"timestamp": "2024-01-15T10:00:00Z", "message": {"model": "m", "usage": {"input_tokens": 7}}})
    assert tokens(read_usage(spark, "claude", root).first()) == (7, 0, 0, 0)


def test_dedup_first_wins_over_files(spark, put):
    put("a.jsonl", claude_line(mid="msg_123", rid="req_456", costUSD=1.0), claude_line(mid="msg_789", rid="req_012", costUSD=3.0))
    root = put("b.jsonl", claude_line(mid="msg_123", rid="req_456", costUSD=2.0))
    rows = read_usage(spark, "claude", root).collect()
    assert sorted(r.total_cost for r in rows) == [1.0, 3.0]


def test_dedup_key_forms(spark, put):
    root = put(
        "a.jsonl",
        claude_line(mid="m"), claude_line(mid="m"),
        claude_line(rid="r"), claude_line(rid="r"),
        claude_line(), claude_line(),
        claude_line(mid="x", rid="y"), claude_line(mid="x-y"),
    )
    assert read_usage(spark, "claude", root).count() == 5


def test_dedup_runs_before_validity(spark, put):
    root = put("a.jsonl", claude_line(mid="m", rid="r", isApiErrorMessage=True), claude_line(mid="m", rid="r"))
    assert read_usage(spark, "claude", root).count() == 0


def test_recent_files_only(spark, put, tmp_path):
    put("old.jsonl", claude_line(sessionId="old"))
    root = put("new.jsonl", claude_line(sessionId="new"))
    border = datetime(2024, 1, 2, tzinfo=timezone.utc)
    os.utime(tmp_path / "old.jsonl", (border.timestamp() - 1,) * 2)
    os.utime(tmp_path / "new.jsonl", (border.timestamp(),) * 2)
    assert [r.session_id for r in read_usage(spark, "claude", root, modified_since=border).collect()] == ["new"]


def codex_count(ts="2024-01-15T10:00:00Z", total=None, last=None):
    def counts(c):
        return None if c is None else {"input_tokens": c[0], "output_tokens": c[1], **(c[2] if len(c) > 2 else {})}

    return {"type": "event_msg", "timestamp": ts, "payload": {"type": "token_count", "info": {
        "total_token_usage": counts(total), "last_token_usage": counts(last)}}}


def codex_model(name):
    return {"type": "turn_context", "model_id": name}


def codex(spark, root):
    rows = read_usage(spark, "codex", root).orderBy("_file", "_ord").collect()
    return [(r.model, r.input_tokens, r.output_tokens, r.cache_read_tokens) for r in rows]


def test_codex_cumulative_totals(spark, put):
    root = put("sess-1.jsonl", codex_model("gpt-5-codex"), codex_count(total=(100, 50)), codex_count(total=(300, 150)))
    assert codex(spark, root) == [("gpt-5", 100, 50, 0), ("gpt-5", 200, 100, 0)]
    row = read_usage(spark, "codex", root).first()
    assert (row.session_id, row.project, row.instance_id, row.total_cost) == ("sess-1", None, None, None)


def test_codex_last_usage_and_default_model(spark, put):
    root = put("s.jsonl", codex_count(total=(500, 200), last=(50, 20)), codex_count(total=(600, 210)))
    assert codex(spark, root) == [("gpt-5", 50, 20, 0), ("gpt-5", 100, 10, 0)]


def test_codex_totals_per_model_and_floor(spark, put):
    root = put(
        "s.jsonl",
        codex_model("a"), codex_count(total=(100, 10)),
        codex_model("b"), codex_count(total=(150, 20)),
        codex_model("a"), codex_count(total=(90, 30)),
        codex_count(ts="bad", total=(1000, 1000)),
        codex_count(total=(91, 31)),
        codex_count(total=(91, 31)),
        "broken", {"type": "event_msg", "payload": {"type": "other"}}, {"type": "event_msg"},
    )
    assert codex(spark, root) == [("a", 100, 10, 0), ("b", 150, 20, 0), ("a", 0, 20, 0), ("a", 1, 1, 0)]


def test_codex_cached_tokens(spark, put):
    root = put(
        "s.jsonl",
        codex_count(last=(9, 1, {"cached_input_tokens": 4, "cache_read_tokens": 7})),
        codex_count(last=(9, 1, {"cached_input_tokens": 0, "cache_read_input_tokens": 7})),
    )
    assert [r[3] for r in codex(spark, root)] == [4, 7]


def test_codex_reads_only_the_top_folder(spark, put):
    put("deep/x.jsonl", codex_count(last=(1, 1)))
    assert codex(spark, put("top.jsonl", codex_count(last=(2, 2)))) == [("gpt-5", 2, 2, 0)]


def test_codex_large_file_is_cut_into_chunks(spark, put):
    """Model and totals carry over split borders: same result for one split and for many."""
    lines, expected, totals, model = [], [], {}, "gpt-5"
    for i in range(400):
        if i % 97 == 5:
            model = f"m{i % 2}"
            lines.append(codex_model(model))
        total = (i * 10 + 1, i * 3 + 1)
        lines.append(codex_count(total=total))
        before = totals.get(model, (0, 0))
        expected.append((model, total[0] - before[0], total[1] - before[1], 0))
        totals[model] = total
    root = put("big.jsonl", *lines)
    assert codex(spark, root) == expected
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    saved = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "4096")
        assert read_lines(spark, root, "*.jsonl").select("_chunk").distinct().count() > 5
        assert codex(spark, root) == expected
    finally:
        for name, value in saved.items():
            spark.conf.set(name, value)


def test_codex_large_file_beside_small_ones(spark, put):
    """Splits depend on all files of a scan; the carry-over must use the same ones."""
    lines = [codex_model("o4-mini"), *(codex_count(total=(10 * i, 3 * i)) for i in range(1, 3001))]
    root = put("big.jsonl", *lines)
    for k in range(10):
        put(f"small{k}.jsonl", codex_count(last=(1, 1)))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    saved = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set(names[0], "200000")
        spark.conf.set(names[1], "20000")
        rows = codex(spark, root)
    finally:
        for name, value in saved.items():
            spark.conf.set(name, value)
    assert sorted(rows) == sorted([("o4-mini", 10, 3, 0)] * 3000 + [("gpt-5", 1, 1, 0)] * 10)


def test_opencode(spark, put):
    message = {
        "id": "m1", "sessionID": "s1", "modelID": "gemini-3-pro-high", "cost": 0.25, "time": {"created": 1705312800.5},
        "tokens": {"input": 10, "output": 5, "cache": {"read": 3, "write": 2}},
    }
    put("a.json", message)
    put("b.json", {**message, "cost": 9.0})
    put("c.json", {"id": "m2", "sessionID": "s1", "modelID": "x", "tokens": {"input": 0, "output": 0}})
    put("d.json", {"id": "m3", "sessionID": "s2", "modelID": "x", "tokens": {"input": 1}})
    put("e.json", {"id": "m4", "modelID": "x", "tokens": {"input": 1}})
    put("f.json", {"id": "m5", "sessionID": "s2", "modelID": "x"})
    root = put("g.json", "{ broken")
    first, second = read_usage(spark, "opencode", root, as_of="2024-02-01T00:00:00Z").orderBy("session_id").collect()
    assert (first.model, first.total_cost, tokens(first)) == ("gemini-3-pro-preview", 0.25, (10, 5, 2, 3))
    assert first.ts == datetime(2024, 1, 15, 10, 0, 0, 500000)
    assert (second.session_id, second.ts) == ("s2", datetime(2024, 2, 1))


def test_amp(spark, put):
    root = put("T-abc123.json", {
        "id": "T-abc123",
        "messages": [
            {"id": "msg-1", "usage": {"cache_creation_input_tokens": 1, "cache_read_input_tokens": 1}},
            {"id": "msg-1", "usage": {"cache_creation_input_tokens": 50, "cache_read_input_tokens": 100}},
            {"id": "msg-1"},
            {"id": "msg-2"},
        ],
        "usageLedger": {"events": [
            {"messageId": "msg-1", "model": "claude-opus-4", "inputTokens": 500, "outputTokens": 200, "credits": 0.05,
             "createdAt": "2024-01-15T10:00:00Z"},
            {"messageId": "msg-9", "inputTokens": 5, "createdAt": "2024-01-15T10:01:00Z"},
            {"messageId": "msg-2", "inputTokens": 6, "createdAt": "2024-01-15T10:02:00Z"},
            {"inputTokens": 7, "createdAt": "2024-01-15T10:03:00Z"},
            {"inputTokens": 1, "createdAt": "yesterday"},
            {"inputTokens": 1},
            {"createdAt": "2024-01-15T10:00:00Z"},
        ]},
    })
    put("other.json", {"id": "x", "usageLedger": {"events": [{"inputTokens": 1, "createdAt": "2024-01-15T10:00:00Z"}]}})
    put("T-none.json", {"id": "T-none"})
    rows = read_usage(spark, "amp", root).orderBy("ts").collect()
    assert [(r.session_id, r.model, r.total_cost, *tokens(r)) for r in rows] == [
        ("T-abc123", "claude-opus-4", 0.05, 500, 200, 50, 100),
        ("T-abc123", "unknown", None, 5, 0, 0, 0),
        ("T-abc123", "unknown", None, 6, 0, 0, 0),
        ("T-abc123", "unknown", None, 7, 0, 0, 0),
    ]


def test_pi(spark, put):
    usage = {"input": 500, "output": 200, "cacheRead": 50, "cacheWrite": 10, "cost": {"total": 0.4}}
    put("my project+x/se ss+1.jsonl",
        {"timestamp": "2024-01-15T10:00:00Z", "message": {"role": "assistant", "model": "claude-opus-4", "usage": usage}},
        {"timestamp": "2024-01-15T10:00:01Z", "message": {"role": "assistant", "usage": {"input": 1}}},
        {"timestamp": "2024-01-15T10:00:00Z", "message": {"role": "user", "model": "m", "usage": usage}},
        {"timestamp": "2024-01-15T10:00:00Z", "message": {"role": "assistant", "model": "m"}},
        {"message": {"role": "assistant", "model": "m", "usage": usage}},
        {"timestamp": "2024-01-15T10:00:00Z", "message": {"role": "assistant", "usage": {"input": 0, "output": 0}}},
        "broken")
    put("top.jsonl", {"timestamp": "2024-01-15T10:00:00Z", "message": {"role": "assistant", "usage": usage}})
    root = put("a/b/deep.jsonl", {"timestamp": "2024-01-15T10:00:00Z", "message": {"role": "assistant", "usage": usage}})
    first, second = read_usage(spark, "pi", root).orderBy("ts").collect()
    assert (first.project, first.session_id, first.model) == ("my project+x", "se ss+1", "[pi] claude-opus-4")
    assert (tokens(first), first.total_cost) == ((500, 200, 10, 50), 0.4)
    assert second.model == "[pi] unknown"


def test_missing_folder_is_empty(spark, tmp_path):
    for provider in PROVIDERS:
        assert read_usage(spark, provider, str(tmp_path / "none"), as_of="2024-01-01").count() == 0


def test_union_and_unknown_provider(spark, put):
    root = put("x.jsonl", claude_line())
    one = read_usage(spark, "claude", root)
    assert union_usage(one, one).columns == USAGE_COLUMNS
    with pytest.raises(ValueError):
        read_usage(spark, "nobody", root)


def test_json_is_parsed_once(spark, put):
    """The filters after parsing must not be pushed below the parser."""
    root = put("x.jsonl", claude_line())
    plan = read_usage(spark, "claude", root)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_json") == 1


def test_amp_bundles_hold_a_thread_per_line(spark, put):
    def thread(name, tokens):
        event = {"messageId": "m", "model": "x", "inputTokens": tokens, "outputTokens": 1, "createdAt": "2024-01-15T10:00:00Z"}
        usage = {"cache_creation_input_tokens": tokens + 1, "cache_read_input_tokens": 0}
        return {"id": name, "messages": [{"id": "m", "usage": usage}], "usageLedger": {"events": [event, event]}}

    put("threads/T-one.json", json.dumps(thread("T-one", 1), indent=1))
    folder = put("threads/T-many.jsonl", thread("T-two", 2), "broken", thread("T-three", 3))
    rows = read_usage(spark, "amp", f"{folder}/threads").collect()
    assert sorted((r["session_id"], r["input_tokens"], r["cache_creation_tokens"]) for r in rows) == [
        ("T-one", 1, 2), ("T-one", 1, 2), ("T-three", 3, 4), ("T-three", 3, 4), ("T-two", 2, 3), ("T-two", 2, 3)]
    assert len({(r["_file"], r["_ord"]) for r in rows}) == 6


def test_amp_files_of_the_demo_are_far_fewer_than_threads(spark):
    events = spark.range(200_000).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 1}' AS props")
    assert wire.amp_files(events).select("_file").distinct().count() <= wire.AMP_THREAD_EVENTS + 8


def test_pi_folders_are_listed_and_not_their_files(spark, put):
    line = {"timestamp": "2024-01-15T10:00:00Z", "message": {"role": "assistant", "usage": {"input": 1}}}
    put("a [x]/s1.jsonl", line)
    put("b/s2.jsonl", line)
    put("b/deeper/s3.jsonl", line)
    root = put("s4.jsonl", line)
    assert len(subfolders(spark, root)) == 2
    rows = read_usage(spark, "pi", root).collect()
    assert sorted((r["project"], r["session_id"]) for r in rows) == [("a [x]", "s1"), ("b", "s2")]


def test_demo_log_files_are_written_whole_with_their_time(spark):
    lines = spark.range(3000).selectExpr("concat('line ', id) AS value", "concat('a/', id % 300, '.jsonl') AS _file", "id AS _ord")
    moment = datetime(2024, 1, 1, tzinfo=timezone.utc)
    folder = wire.write_logs(lines.where("_ord < 1500"))
    assert wire.write_logs(lines, folder, modified=wire.F.lit(moment)) == folder
    path = folder.removeprefix("file:")
    assert sorted(os.listdir(f"{path}/a")) == sorted(f"{n}.jsonl" for n in range(300))  # no hidden leftovers, no checksums
    with open(f"{path}/a/7.jsonl") as file:
        assert file.read() == "".join(f"line {n}\n" for n in range(7, 3000, 300))
    assert os.path.getmtime(f"{path}/a/7.jsonl") == moment.timestamp()
