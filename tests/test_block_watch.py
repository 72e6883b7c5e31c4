"""Blocks after each micro-batch are those of the batch job; blocks that did not change are not written again."""

import random

import pytest
from pyspark.sql import functions as F

from meterlake import BlockReport, billing_blocks, historical_max
from meterlake.schemas import USAGE
from meterlake.streaming.blocks import BlockWatch, start_block_watch
from tests.test_streaming import comparable

AS_OF = "2024-01-04T20:00:00"


def entry(n, minute, key="s", project="p"):
    """Minute since the first of January."""
    stamp = f"2024-01-{1 + minute // 1440:02d} {minute // 60 % 24:02d}:{minute % 60:02d}:30"
    return dict(session_id=key, ts=stamp, model=f"claude-3-{['opus', 'haiku'][n % 2]}", input_tokens=1000 * n, project=project, _ord=n)


@pytest.fixture()
def usage_of(spark, make_usage):
    def build(rows):
        from datetime import datetime

        return make_usage(*[{**r, "ts": datetime.fromisoformat(r["ts"])} for r in rows])

    return build


def rows_of(blocks):
    return sorted((tuple(r) for r in blocks.collect()), key=str)


@pytest.mark.parametrize("keys", [(), ("project",)])
def test_shuffled_batches(spark, tmp_path, prices, usage_of, keys):
    g = random.Random(len(keys))
    entries = [entry(n, g.choice([g.randrange(5700), 600 + n * 7]), f"s{n % 3}", [None, "p", "q"][n % 3]) for n in range(60)]
    report = BlockReport(AS_OF, 5.0, keys)
    watch = BlockWatch(spark, str(tmp_path / "t"), report, prices)
    g.shuffle(entries)
    there = []
    for number in range(3):
        new = entries[number * 20 : number * 20 + 20]
        gone = [there.pop(g.randrange(len(there))) for _ in range(3)] if number else []
        there += new
        batch = usage_of(new).withColumn("sign", F.lit(1))
        if gone:
            batch = batch.unionByName(usage_of(gone).withColumn("sign", F.lit(-1)))
        watch.absorb(batch, number)
        if number == 1:
            watch.absorb(batch, number)  # a replay
        expected = billing_blocks(usage_of(there), prices, AS_OF, keys=keys)
        assert rows_of(watch.current()) == rows_of(expected.select(watch.current().columns)), number
        assert watch.historical_max().first()[0] == pytest.approx(historical_max(expected).first()[0], abs=1e-12)


def test_only_changed_blocks_are_written(spark, tmp_path, prices, usage_of):
    watch = BlockWatch(spark, str(tmp_path / "t"), BlockReport(AS_OF), prices)
    first = [entry(n, 600 * n) for n in range(1, 9)]  # a block each
    written = []
    absorb = watch.blocks.put
    watch.blocks.put = lambda number, rows: (absorb(number, rows), written.append({r["_start_hour"] % 1000: r["alive"] for r in watch.blocks.latest().collect()}))

    def add(number, *rows):
        watch.absorb(usage_of(rows).withColumn("sign", F.lit(1)), number)

    add(0, *first)
    assert len(written[0]) == 8 and all(written[0].values())
    add(1, entry(20, 610))  # in a block that is there
    assert len(written[1]) == 1
    add(2, entry(21, 30))  # a block of its own before all others
    assert len(written[2]) == 1
    add(3, entry(22, 480))  # opens two hours earlier and takes the next block in
    assert sorted(written[3].values()) == [False, True]
    add(4, entry(23, 1500))  # between two blocks
    assert len(written[4]) == 1
    dearest = watch.historical_max().first()[0]
    less = usage_of([first[-1], entry(20, 610)]).withColumn("sign", F.lit(-1))
    watch.absorb(less, 5)
    assert sorted(written[5].values()) == [False, True]
    assert watch.historical_max().first()[0] < dearest


def test_as_a_stream(spark, tmp_path, prices, usage_of):
    source, seen = str(tmp_path / "in"), []
    for part in range(3):
        rows = [entry(n, 400 * ((n * 7) % 13), f"s{n % 2}") for n in range(part, 13, 3)]
        usage_of(rows).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).parquet(source).withColumn("sign", F.lit(1))
    report = BlockReport(AS_OF, 2.5)
    start_block_watch(stream, report, prices, str(tmp_path / "t"), str(tmp_path / "c"), lambda w, n: seen.append(n)).awaitTermination()
    watch = BlockWatch(spark, str(tmp_path / "t"), report, prices)
    expected = billing_blocks(spark.read.schema(USAGE).parquet(source), prices, AS_OF, hours=2.5)
    assert comparable(watch.current()) == comparable(expected.select(watch.current().columns)) and seen == [0, 1, 2]
    with pytest.raises(ValueError):
        BlockWatch(spark, str(tmp_path / "t"), BlockReport(AS_OF, 0.5), prices)
