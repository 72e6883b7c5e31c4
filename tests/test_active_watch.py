"""Active sessions after each micro-batch are those of the batch job at that moment."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meterlake import active_sessions
from meterlake.schemas import USAGE
from meterlake.streaming.active import active_counts, start_active_watch
from meterlake.streaming.retract import state_conf
from meterlake.streaming.store import BatchStore


def test_sessions_end_as_time_goes_on(spark, make_usage, tmp_path):
    state_conf(spark)
    began = datetime(2024, 1, 15, 10)
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    batches = [
        [("a", 0), ("a", 30.25), ("b", 60), ("b", 60)],
        [("c", 200), ("a", 10)],
        [("c", 355), ("d", 90), ("b", 360.000001)],  # d comes late and is active still; a and the first of b are over
        [("e", 1000), ("c", 350)],
        [("e", 1001)],
    ]
    seen, ticks = [], []

    def check(active, number):
        as_of = BatchStore(spark, table).read().agg(F.max("as_of")).first()[0]
        found = {(r["session_id"], r["entries"]) for r in active.collect()}
        expected = active_sessions(make_usage(*seen), as_of.isoformat())
        assert found == {(r["session_id"], r["entries"]) for r in expected.collect()}, (number, as_of)
        ticks.append((number, found))

    for number, entries in enumerate(batches):
        rows = [dict(session_id=s, ts=began + timedelta(seconds=t), _ord=number) for s, t in entries]
        seen += rows
        make_usage(*rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(USAGE).parquet(source)
        query = start_active_watch(active_counts(stream, since="2024-01-15T00:00:00"), table, str(tmp_path / "c"), check)
        query.awaitTermination()
    assert ticks[-1][1] == {("e", 2)}
    assert len(ticks) > len(batches)  # batches without entries let sessions end
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
