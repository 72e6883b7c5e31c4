"""The ``events`` table rendered as log lines of each provider.

These frames feed the real parsers. They contain bad lines, repeats, missing
fields and time stamps that no parser may accept, at fixed rates.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.demo.events import usage_from_events
from meterlake.session import scratch_dir
from meterlake.streaming.tail import open_folder

AMP_THREAD_EVENTS = 500
AMP_BUNDLE_PARTS = 64
CODEX_CHUNK_EVENTS = 1000


def _base(events: DataFrame) -> DataFrame:
    usage = usage_from_events(events)
    return usage.select(
        F.col("_ord").alias("e"), "session_id", "ts", "model", "project", "instance_id",
        F.col("input_tokens").alias("inp"), F.col("output_tokens").alias("outp"),
        F.col("cache_creation_tokens").alias("cw"), F.col("cache_read_tokens").alias("cr"),
        F.col("total_cost").alias("cost"),
    )


def _rendered(text: Column) -> Column:
    """The text as a generated row: later filters then do not render it a second time."""
    return F.explode(F.array(text)).alias("value")


def _every(n: int) -> Column:
    return F.col("e") % n == 0


def _time() -> Column:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(_every(31), F.lit("not a time")).otherwise(text)


def claude_lines(events: DataFrame) -> DataFrame:
    keyed = ~_every(13)
    record = F.struct(
        _time().alias("timestamp"),
        F.col("session_id").alias("sessionId"),
        F.when(_every(19), F.lit("user")).when(_every(2), F.lit("assistant")).alias("type"),
        F.col("instance_id").alias("uuid"),
        F.concat(F.lit("/home/dev/"), F.col("project")).alias("cwd"),
        F.when(keyed, F.concat(F.lit("r"), F.col("e") % 2500)).alias("requestId"),
        F.col("cost").alias("costUSD"),
        F.when(_every(23), F.lit(True)).alias("isApiErrorMessage"),
        F.struct(
            F.when(_every(29), F.lit("<synthetic>")).otherwise(F.col("model")).alias("model"),
            F.when(keyed, F.concat(F.lit("m"), F.col("e") % 5000)).alias("id"),
            F.struct(
                F.col("inp").alias("input_tokens"), F.col("outp").alias("output_tokens"),
                F.col("cw").alias("cache_creation_input_tokens"), F.col("cr").alias("cache_read_input_tokens"),
            ).alias("usage"),
        ).alias("message"),
    )
    line = F.when(_every(17), F.lit('{"broken": ')).otherwise(F.to_json(record))
    return _base(events).select(
        _rendered(line), F.concat(F.lit("logs/"), F.col("session_id"), F.lit(".jsonl")).alias("_file"),
        F.col("e").alias("_ord"),
    )


def codex_lines(events: DataFrame) -> DataFrame:
    """One file per session; sign-ups switch the model, everything else reports running totals."""
    switch = F.col("model") == "claude-sonnet-4-5-20250929"
    new_model = F.when(_every(2), F.lit("gpt-5-codex")).otherwise(F.lit("o4-mini"))
    total = F.struct(
        F.col("e").alias("input_tokens"), (F.col("e") - F.col("e") % 2).alias("output_tokens"),
        (F.col("e") % 7).alias("cached_input_tokens"), F.lit(5).alias("cache_read_tokens"),
    )
    last = F.when(F.col("model") == "claude-3-5-sonnet", F.struct(
        F.col("inp").alias("input_tokens"), F.col("outp").alias("output_tokens"), F.col("cr").alias("cached_input_tokens"),
    ))
    count = F.struct(
        F.lit("event_msg").alias("type"), _time().alias("timestamp"),
        F.struct(F.lit("token_count").alias("type"), F.struct(
            F.when(~_every(11), total).alias("total_token_usage"), last.alias("last_token_usage"),
        ).alias("info")).alias("payload"),
    )
    context = F.struct(F.lit("turn_context").alias("type"), new_model.alias("model_id"))
    line = F.when(_every(17), F.lit("broken")).when(switch, F.to_json(context)).otherwise(F.to_json(count))
    e = F.col("e")
    return _base(events).select(
        _rendered(line), F.concat(F.lit("sessions/"), F.col("session_id"), F.lit(".jsonl")).alias("_file"),
        (e - e % CODEX_CHUNK_EVENTS).alias("_chunk"), e.alias("_ord"),
    )


def write_logs(lines: DataFrame, folder: str | None = None, modified: Column | None = None) -> str:
    """The lines as real log files, one per ``_file``, below a folder in the shared scratch space.

    Tasks write the files under their names, so neither the driver nor a commit handles them one by
    one; a file is put in place by a rename, whichever attempt of a task comes last. ``folder`` is an
    earlier result, whose files of the same name are replaced. ``modified`` is the time at which a
    file was last written to, as far as it is not null; only local folders keep it.
    """
    folder = folder or f"{scratch_dir(lines.sparkSession)}/logs-{uuid.uuid4()}"
    place = lines.select(
        F.url_decode(F.regexp_extract("_file", "([^/]*)/[^/]*$", 1)).alias("dir"), F.regexp_extract("_file", "([^/]*)$", 1).alias("name"),
        F.unix_seconds(F.lit(None).cast("timestamp") if modified is None else modified).alias("modified"), "_ord", "value")
    named = place.repartition("dir", "name").sortWithinPartitions("dir", "name", "_ord").drop("_ord")
    named.mapInArrow(_FileWriter(folder), "files bigint").agg(F.sum("files")).first()
    return folder


class _FileWriter:
    """Writes rows that are sorted by file; gives the number of files."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_folder(self.folder)
        made: set[str] = set()
        current, stream, files = None, None, 0
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("dir", "name", "modified", "value")]
            for file, rows in itertools.groupby(zip(*columns), key=lambda row: row[:3]):
                if file != current:
                    if stream:
                        self._close(filesystem, root, current, stream)
                    if file[0] not in made:
                        filesystem.create_dir(f"{root}/{file[0]}", recursive=True)
                        made.add(file[0])
                    current, files = file, files + 1
                    stream = filesystem.open_output_stream(self._unfinished(root, file))
                stream.write("".join(f"{row[3] or ''}\n" for row in rows).encode())
        if stream:
            self._close(filesystem, root, current, stream)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    @staticmethod
    def _unfinished(root: str, file: tuple) -> str:
        """A hidden name, which no reader sees."""
        return f"{root}/{file[0]}/.{file[1]}.{TaskContext.get().taskAttemptId()}"

    def _close(self, filesystem: fs.FileSystem, root: str, file: tuple, stream) -> None:
        stream.close()
        written = self._unfinished(root, file)
        if file[2] is not None and isinstance(filesystem, fs.LocalFileSystem):
            os.utime(written, (file[2], file[2]))
        filesystem.move(written, f"{root}/{file[0]}/{file[1]}")


def set_file_time(spark: SparkSession, pattern: str, moment: datetime) -> None:
    """Makes the files look as if last written at ``moment``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(pattern).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.globStatus(hadoop.Path(pattern)) or []:
        system.setTimes(status.getPath(), int(moment.timestamp() * 1000), -1)


def opencode_documents(events: DataFrame) -> DataFrame:
    record = F.struct(
        F.concat(F.lit("m"), F.col("e") % 7000).alias("id"),
        F.col("session_id").alias("sessionID"),
        F.when(F.col("model") == "claude-3-haiku", F.lit("gemini-3-pro-high")).otherwise(F.col("model")).alias("modelID"),
        F.col("cost"),
        F.struct(F.when(~_every(10), F.unix_seconds("ts") + F.lit(0.25)).alias("created")).alias("time"),
        F.struct(
            F.col("inp").alias("input"), F.col("outp").alias("output"),
            F.when(~_every(4), F.struct(F.col("cr").alias("read"), F.col("cw").alias("write"))).alias("cache"),
        ).alias("tokens"),
    )
    text = F.when(_every(17), F.lit("{")).otherwise(F.to_json(record))
    return _base(events).select(_rendered(text), F.format_string("message/%012d.json", F.col("e")).alias("_file"))


def amp_documents(events: DataFrame) -> DataFrame:
    """Threads of one session and at most ``AMP_THREAD_EVENTS`` neighbouring events."""
    e = F.col("e")
    empty = F.struct(F.lit(1).alias("cache_creation_input_tokens"), F.lit(1).alias("cache_read_input_tokens"))
    real = F.struct(F.col("cw").alias("cache_creation_input_tokens"), F.col("cr").alias("cache_read_input_tokens"))
    item = F.struct(
        e,
        F.struct(F.concat(F.lit("m"), e).alias("id"), empty.alias("usage")).alias("early"),
        F.struct(F.concat(F.lit("m"), e).alias("id"), F.when(~_every(3), real).alias("usage")).alias("late"),
        F.struct(
            F.when(~_every(5), F.concat(F.lit("m"), e)).alias("messageId"),
            F.when(~_every(6), F.col("model")).alias("model"),
            F.col("inp").alias("inputTokens"), F.col("outp").alias("outputTokens"),
            F.col("cost").alias("credits"), _time().alias("createdAt"),
        ).alias("event"),
    )
    threads = (
        _base(events)
        .groupBy("session_id", ((e - e % AMP_THREAD_EVENTS) / AMP_THREAD_EVENTS).cast("bigint").alias("part"))
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
    thread_id = F.concat(F.lit("T-"), F.col("session_id"), F.lit("-"), F.col("part"))
    document = F.struct(
        thread_id.alias("id"),
        F.concat(F.transform("items", lambda i: i["early"]), F.transform("items", lambda i: i["late"])).alias("messages"),
        F.struct(F.transform("items", lambda i: i["event"]).alias("events")).alias("usageLedger"),
    )
    return threads.select(_rendered(F.to_json(document)), F.concat(thread_id, F.lit(".json")).alias("_file"), "part")


def amp_files(events: DataFrame) -> DataFrame:
    """Threads of the first events as a file each, the others as lines of bundles.

    There are nearly as many threads as events. Those of the first part are at most
    ``AMP_THREAD_EVENTS``, and a bundle holds ``AMP_BUNDLE_PARTS`` parts.
    """
    bundle = F.format_string("T-bundle-%08d.jsonl", F.floor(F.col("part") / AMP_BUNDLE_PARTS))
    file = F.when(F.col("part") == 0, F.col("_file")).otherwise(bundle)
    return amp_documents(events).select("value", F.concat(F.lit("threads/"), file).alias("_file"), F.lit(0).alias("_ord"))


def pi_lines(events: DataFrame) -> DataFrame:
    record = F.struct(
        _time().alias("timestamp"),
        F.struct(
            F.when(_every(19), F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
            F.when(~_every(6), F.col("model")).alias("model"),
            F.struct(
                F.col("inp").alias("input"), F.col("outp").alias("output"),
                F.col("cr").alias("cacheRead"), F.col("cw").alias("cacheWrite"),
                F.struct(F.col("cost").alias("total")).alias("cost"),
            ).alias("usage"),
        ).alias("message"),
    )
    line = F.when(_every(17), F.lit("broken")).otherwise(F.to_json(record))
    folder = F.coalesce("project", F.lit("no project"))
    path = F.concat(F.lit("/sessions/"), F.replace(folder, F.lit(" "), F.lit("%20")), F.lit("/"), F.col("session_id"), F.lit(".jsonl"))
    return _base(events).select(_rendered(line), path.alias("_file"), F.col("e").alias("_ord"))
