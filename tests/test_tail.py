"""Lines appended to files are read once, whatever becomes of the files."""

import os
import shutil

import pytest

from meterlake.streaming import tail
from meterlake.streaming.tail import tail_lines


@pytest.fixture()
def watch(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()

    class Watch:
        folder = logs
        split, full_every = 64 << 20, 16

        def write(self, name, text, mode="wb"):
            path = logs / name
            path.parent.mkdir(parents=True, exist_ok=True)
            with open(path, mode) as file:
                file.write(text if isinstance(text, bytes) else text.encode())

        def append(self, name, text):
            self.write(name, text, "ab")

        def run(self):
            """Reads what is new; returns all lines so far as (file name, position, text)."""
            stream = tail_lines(spark, str(logs), str(tmp_path / "state"), split_bytes=self.split, full_every=self.full_every)
            store = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
            writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", str(tmp_path / "check"))
            writer.trigger(availableNow=True).start().awaitTermination()
            (tmp_path / "out" / "batch=0").mkdir(parents=True, exist_ok=True)
            rows = spark.read.schema("value string, _file string, _ord bigint").parquet(str(tmp_path / "out")).collect()
            return sorted((r["_file"].rsplit("/", 1)[1], r["_ord"], r["value"]) for r in rows)

    return Watch()


def test_appended_rotated_truncated_removed(watch, tmp_path):
    watch.write("a.jsonl", "one\ntwo\nth")
    watch.write("deep/b.jsonl", "x\r\n")
    watch.write("ignored.txt", "no\n")
    first = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("b.jsonl", 0, "x")]
    assert watch.run() == first
    assert watch.run() == first
    watch.append("a.jsonl", "ree")
    assert watch.run() == first
    watch.append("a.jsonl", "\nfour\n\n")
    second = sorted([*first, ("a.jsonl", 8, "three"), ("a.jsonl", 14, "four"), ("a.jsonl", 19, "")])
    assert watch.run() == second
    # rotated: renamed and gone on under a new name, with a new file in its place
    os.rename(watch.folder / "a.jsonl", watch.folder / "a.1.jsonl")
    watch.append("a.1.jsonl", "five\n")
    watch.write("a.jsonl", "fresh\n")
    third = watch.run()
    assert ("a.1.jsonl", 20, "five") in third or ("a.1.jsonl", 20 + tail.GENERATION, "five") in third
    assert [r[2] for r in third].count("fresh") == 1
    # truncated and written anew, then removed
    watch.write("a.jsonl", "new\n")
    os.remove(watch.folder / "deep" / "b.jsonl")
    fourth = watch.run()
    ((name, place, text),) = set(fourth) - set(third)
    assert (name, text) == ("a.jsonl", "new") and place >= tail.GENERATION
    assert watch.run() == fourth


def test_rename_alone_reads_nothing_again(watch):
    watch.write("a.jsonl", "one\ntwo\n")
    assert len(watch.run()) == 2
    os.rename(watch.folder / "a.jsonl", watch.folder / "b.jsonl")
    assert len(watch.run()) == 2
    watch.append("b.jsonl", "three\n")
    assert watch.run()[-1] == ("b.jsonl", 8, "three")


@pytest.mark.parametrize("split", [1, 7])
def test_ranges_need_no_line_borders(watch, split):
    watch.split = split
    lines = ["é" * (k % 9) for k in range(20)] + ["long " * 30, ""]
    text = "\n".join(lines).encode()
    cut = len(text) // 2
    watch.write("a.jsonl", text[:cut])
    watch.run()
    watch.append("a.jsonl", text[cut:] + b"\n")
    rows = watch.run()
    assert [r[2] for r in rows] == lines
    assert [r[1] for r in rows] == [len("\n".join([*lines[:k], ""]).encode()) for k in range(len(lines))]


def test_line_start_over_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "_BLOCK", 8)
    path = tmp_path / "f"
    text = b"short\n" + b"x" * 50 + b"\n" + b"y" * 20 + b"\nend\nopen"
    path.write_bytes(text)
    filesystem, name = tail.open_folder(str(path))
    with filesystem.open_input_file(name) as file:
        for start in range(len(text)):
            for end in (start + 1, start + 9, len(text)):
                found = [(p, v) for values, at in tail._lines(file, start, min(end, len(text))) for v, p in zip(values, at)]
                expected, at = [], 0
                for line in text.split(b"\n")[:-1]:
                    if start <= at + len(line) < end:
                        expected.append((at, line.decode()))
                    at += len(line) + 1
                assert found == expected, (start, end)


def test_restart_with_many_versions(watch, tmp_path):
    watch.full_every = 2
    for k in range(20):
        watch.append("a.jsonl", f"line {k}\n")
        if k % 7 == 0:
            watch.run()
    assert [r[2] for r in watch.run()] == [f"line {k}" for k in range(20)]
    # a batch that failed before its commit is read again, with the same positions
    before = watch.run()
    watch.append("a.jsonl", "last\n")
    after = watch.run()
    newest = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink()
    shutil.rmtree(tmp_path / "out" / f"batch={newest.name}")
    assert watch.run() == after and len(after) == len(before) + 1


def test_nothing_there(spark, tmp_path):
    stream = tail_lines(spark, str(tmp_path / "none"), str(tmp_path / "state"))
    query = stream.writeStream.format("memory").queryName("nothing").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("nothing").count() == 0


def test_small_files_share_tasks(tmp_path):
    reader = tail.TailReader({"path": str(tmp_path), "state": str(tmp_path / "state")})
    (tmp_path / "logs").mkdir()
    for number in range(2000):
        (tmp_path / "logs" / f"{number:04d}.jsonl").write_text(f"line {number}\nmore\n")
    tasks = reader.partitions({"version": 0}, reader.latestOffset())
    assert len(tasks) <= 2 * tail.MIN_TASKS
    rows = [value for task in tasks for batch in reader.read(task) for value in batch.column("value").to_pylist()]
    assert sorted(rows) == sorted([f"line {n}" for n in range(2000)] + ["more"] * 2000)
