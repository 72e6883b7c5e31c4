"""A stream whose first copies come last gives the batch result after every micro-batch."""

import pytest

from meterlake import BlockReport, session_report
from meterlake.sources import claude
from meterlake.streaming.retract import dedup_changes, exact_usage, settled_meters, start_exact_watch, state_conf
from meterlake.streaming.store import BatchStore
from tests.test_streaming import comparable

LINES = "value string, _file string, _ord bigint"


def lines(file, first, last):
    """Copies of a record differ in time, session, model and tokens; some have no key, some are invalid."""
    rows = []
    for n in range(first, last):
        key = "" if n % 7 == 0 else f', "requestId": "r{n % 11}"'
        model = "<synthetic>" if (n + len(file)) % 6 == 0 else f"claude-3-{['opus', 'haiku'][(n + ord(file)) % 2]}"
        rows.append((
            f'{{"timestamp": "2024-01-{1 + (n + ord(file)) % 28:02d}T{n % 24:02d}:15:00Z", "sessionId": "s{(n + ord(file)) % 4}"{key},'
            f' "costUSD": {"null" if n % 2 else n / 8}, "message": {{"model": "{model}", "usage": {{"input_tokens": {10 * n + ord(file)}, "output_tokens": {n}}}}}}}',
            file, n))
    return rows


@pytest.fixture()
def arrivals():
    """Later names and places come first."""
    return [lines("d", 20, 40) + lines("c", 0, 30), lines("d", 0, 20) + lines("b", 5, 35), lines("a", 10, 20)]


@pytest.mark.parametrize("name", ["sessions", "blocks"])
def test_every_micro_batch_equals_batch(spark, tmp_path, prices, arrivals, name):
    state_conf(spark)
    report = {"sessions": session_report(), "blocks": BlockReport("2024-02-10T00:00:00")}[name]
    table, source, seen, checked = str(tmp_path / "table"), str(tmp_path / "in"), [], []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(LINES).parquet(source)

    def check(meters, number):
        expected = claude.parse(spark.createDataFrame(seen, LINES))
        assert comparable(report.from_meters(meters, prices)) == comparable(report.run(expected, prices)), number
        checked.append(number)

    for rows in arrivals:
        seen += rows
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(source)
        changes = dedup_changes(claude.records(stream))
        start_exact_watch(changes, report, table, str(tmp_path / "check"), check).awaitTermination()
    assert checked == list(range(len(arrivals)))
    batch = claude.parse(spark.createDataFrame(seen, LINES))
    assert sorted(map(str, exact_usage(spark, table).collect())) == sorted(map(str, batch.collect()))
    signs = BatchStore(spark, f"{table}/changes").read().groupBy("sign").count().collect()
    assert {r["sign"] for r in signs} == {1, -1}


def test_unkeyed_records_have_no_state(spark, tmp_path):
    state_conf(spark)
    source = str(tmp_path / "in")
    spark.createDataFrame([r for r in lines("a", 0, 60) if "requestId" not in r[0]], LINES).write.parquet(source)
    changes = dedup_changes(claude.records(spark.readStream.schema(LINES).parquet(source)))
    query = changes.writeStream.format("memory").queryName("unkeyed").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("unkeyed").count() > 0
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_store_merges_and_survives_crashes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    make = lambda k: spark.range(k, k + 1)
    store = BatchStore(spark, path, lambda df: df.coalesce(1), fan_in=3)
    assert store.read() is None and store.last_batch == -1
    for k in range(20):
        store.put(k, make(k))
        store.put(k, make(1000))  # a replay
        if k == 7:
            with monkeypatch.context() as patch:
                patch.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
                with pytest.raises(RuntimeError):
                    store.put(99, make(99))
        store.tidy()
    assert sorted(r[0] for r in store.read().collect()) == list(range(20))
    assert len(store.folders()) <= 6
    assert len(list((tmp_path / "store" / "data").iterdir())) <= 12
    with monkeypatch.context() as patch:
        patch.setattr(store, "_sweep", lambda: (_ for _ in ()).throw(RuntimeError("crash")))
        store.put(20, make(20))
        with pytest.raises(RuntimeError):
            store.tidy()
    again = BatchStore(spark, path, lambda df: df.coalesce(1), fan_in=3)
    assert sorted(r[0] for r in again.read().collect()) == list(range(21)) and again.last_batch == 20
