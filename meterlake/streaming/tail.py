"""A streaming source of the lines that are appended to log files.

The file source hands a file out once and misses what is appended to it. This
one remembers how far each file has been read. A trigger lists the folder,
compares it with what it knows, and reads the new byte ranges only, cut into
pieces of ``split_bytes`` that executors read side by side. A line belongs to
the range that holds its line end, wherever it begins: the rest of a line that
is still being written is carried to the trigger that sees its end, and no
range has to be aligned.

What has been read stays counted:

* appended: same beginning and same bytes before the old end; only the new bytes are read;
* rotated by renaming: a new name for a known file that is gone, with its
  beginning and its old end, is read on from there;
* truncated or rewritten: a new generation of the file, read from its start;
* removed: nothing happens.

``_ord`` is the byte at which the line starts, after the generation in the
upper bits, so lines of a file are in order and a line has the same position in every
replay. Progress is a version number; what a version means (the known
files and the ranges to read) is a file in the folder ``state``, a difference
to the version before it or, every ``full_every`` versions, all known files. Known files are held
by the driver, as those of the file source are. Paths are what ``pyarrow.fs`` can open: local
or mounted folders, HDFS, object stores.

A last line without line end waits for it. Invalid UTF-8 is replaced.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, _file string, _ord bigint"
_ROWS = pa.schema([("value", pa.string()), ("_file", pa.string()), ("_ord", pa.int64())])

FULL_EVERY = 16
SPLIT_BYTES = 64 << 20

#: Bytes that tell files apart, at the beginning and before the old end.
PROBE = 1024

#: What opening a file counts for in bytes, and the tasks that few files are spread over.
OPEN_COST = 256 << 10
MIN_TASKS = 32

#: Lines of small files that go to Spark together.
BATCH_LINES = 4096

_BLOCK = 1 << 20

#: Position of a line: its generation times this, plus its first byte.
GENERATION = 1 << 44


def tail_lines(spark: SparkSession, path: str, state: str, glob: str = "*.jsonl", split_bytes: int = SPLIT_BYTES, full_every: int = FULL_EVERY) -> DataFrame:
    """``value, _file, _ord`` of the lines below ``path``, as they are appended. ``state`` belongs to one query."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(path=path, state=state, glob=glob, split_bytes=split_bytes, full_every=full_every).load()


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


@dataclass
class ByteRange(InputPartition):
    path: str
    generation: int
    start: int
    end: int


@dataclass
class ByteRanges(InputPartition):
    """Ranges that one task reads one after the other."""

    ranges: list[ByteRange]


@dataclass
class Known:
    """What is known of a file: all bytes before ``size`` have been handed out."""

    generation: int
    size: int
    modified: int
    probe: str


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.state, self.glob = options["path"], options["state"], options.get("glob", "*.jsonl")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.full_every = int(options.get("full_every", FULL_EVERY))
        self.known: dict[str, Known] | None = None
        self.version = 0

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        if self.known is None:
            self.known, self.version = self._restored()
        changes, ranges = self._changes()
        if changes:
            self.known.update({path: Known(*k) for path, k in changes.items() if k})
            for path in [p for p, k in changes.items() if not k]:
                self.known.pop(path, None)
            self.version += 1
            everything = self.version % self.full_every == 0
            files = {p: list(vars(k).values()) for p, k in self.known.items()} if everything else changes
            self._save({"full": everything, "files": files, "ranges": ranges})
        return {"version": self.version}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        found = []
        for version in range(start["version"] + 1, end["version"] + 1):
            for path, generation, first, last in self._load(version)["ranges"]:
                found += [ByteRange(path, generation, a, min(a + self.split, last)) for a in range(first, last, self.split)]
        return self._packed(found)

    def _packed(self, ranges: list[ByteRange]) -> list[ByteRanges]:
        """Small files share a task, up to ``split_bytes`` with ``OPEN_COST`` for each; few files have a task each."""
        sizes = [r.end - r.start + OPEN_COST for r in ranges]
        most = min(self.split, sum(sizes) / MIN_TASKS)
        packed: list[ByteRanges] = []
        held = 0
        for byte_range, size in zip(ranges, sizes):
            if not packed or held + size > most:
                packed.append(ByteRanges([]))
                held = 0
            packed[-1].ranges.append(byte_range)
            held += size
        return packed

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_folder(self.path)
        values: list[str] = []
        names: list[str] = []
        ords: list[int] = []
        for part in partition.ranges:
            name = part.path if isinstance(filesystem, fs.LocalFileSystem) else f"{self.path.rstrip('/')}{part.path.removeprefix(root)}"
            shown = f"file://{quote(part.path)}" if isinstance(filesystem, fs.LocalFileSystem) else name
            with filesystem.open_input_file(part.path) as file:
                for lines, positions in _lines(file, part.start, part.end):
                    values += lines
                    names += [shown] * len(lines)
                    ords += [part.generation * GENERATION + p for p in positions]
                    if part.end - part.start > _BLOCK or len(values) >= BATCH_LINES:
                        yield _rows(values, names, ords)
                        values, names, ords = [], [], []
        if values:
            yield _rows(values, names, ords)

    def commit(self, end: dict) -> None:
        """Versions before the last full one that is no later than ``end`` are not needed any more."""
        full = end["version"] - end["version"] % self.full_every
        filesystem, folder = open_folder(self.state)
        for version in self._versions():
            if version < full:
                filesystem.delete_file(f"{folder}/{version:012d}.json")

    def _changes(self) -> tuple[dict, list]:
        """Known files that are new, changed or (None) gone, and the ranges to read."""
        filesystem, root = open_folder(self.path)
        selector = fs.FileSelector(root, allow_not_found=True, recursive=True)
        listed = {i.path: i for i in filesystem.get_file_info(selector)
                  if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob) and not i.base_name.startswith((".", "_"))}
        touched = [i for path, i in listed.items() if path not in self.known or (i.size, i.mtime_ns) != (self.known[path].size, self.known[path].modified)]
        gone = {path: k for path, k in self.known.items() if path not in listed}

        def examine(info) -> tuple:
            """(path, known file it goes on from or None, Known)."""
            with filesystem.open_input_file(info.path) as file:
                old = self.known.get(info.path)
                before = [(info.path, old)] if old else list(gone.items())
                same = next((p for p, k in before if 0 < k.size <= info.size and _probe(file, k.size) == k.probe), None)
                generation = self.known[same].generation if same else old.generation + 1 if old else 0
                return info.path, same, Known(generation, info.size, info.mtime_ns, _probe(file, info.size))

        with ThreadPoolExecutor(16) as pool:
            examined = list(pool.map(examine, touched))
        changes: dict = dict.fromkeys(gone)
        ranges = []
        for path, same, now in sorted(examined, key=lambda e: e[0]):
            changes[path] = list(vars(now).values())
            start = self.known[same].size if same else 0
            if now.size > start:
                ranges.append([path, now.generation, start, now.size])
        return changes, ranges

    def _versions(self) -> list[int]:
        filesystem, folder = open_folder(self.state)
        files = filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(int(i.base_name.removesuffix(".json")) for i in files if i.base_name.endswith(".json"))

    def _restored(self) -> tuple[dict[str, Known], int]:
        versions = self._versions()
        if not versions:
            return {}, 0
        known: dict[str, Known] = {}
        full = max([v for v in versions if v % self.full_every == 0], default=0)
        for version in versions:
            if version >= full:
                for path, k in self._load(version)["files"].items():
                    known.pop(path, None)
                    if k:
                        known[path] = Known(*k)
        return known, versions[-1]

    def _load(self, version: int) -> dict:
        filesystem, folder = open_folder(self.state)
        with filesystem.open_input_file(f"{folder}/{version:012d}.json") as file:
            return json.loads(file.read())

    def _save(self, content: dict) -> None:
        filesystem, folder = open_folder(self.state)
        filesystem.create_dir(folder, recursive=True)
        written = f"{folder}/{self.version:012d}.tmp"
        with filesystem.open_output_stream(written) as file:
            file.write(json.dumps(content).encode())
        filesystem.move(written, f"{folder}/{self.version:012d}.json")


def _probe(file, size: int) -> str:
    """Digest of the beginning and of the last bytes before ``size``."""
    head = file.read_at(min(PROBE, size), 0)
    last = max(0, size - PROBE)
    return hashlib.sha256(head + b"|" + file.read_at(size - last, last)).hexdigest()


def _rows(values: list[str], names: list[str], ords: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(names, pa.string()), pa.array(ords, pa.int64())], schema=_ROWS)


def _lines(file, start: int, end: int) -> Iterator[tuple[list[str], list[int]]]:
    """Lines whose end lies in the range, with the byte each begins at."""
    rest, at = None, start  # bytes since the last line end, once one was seen
    while at < end:
        block = file.read_at(min(_BLOCK, end - at), at)
        if not block:
            return  # the file has become shorter since it was listed
        *ended, left = block.split(b"\n")
        if ended:
            if rest is None:
                first = _line_start(file, start)
                rest = [file.read_at(at - first, first)]
            lines = [b"".join([*rest, ended[0]]), *ended[1:]]
            begins = at - sum(map(len, rest))
            positions = []
            for line in lines:
                positions.append(begins)
                begins += len(line) + 1
            yield [line.removesuffix(b"\r").decode(errors="replace") for line in lines], positions
            rest = []
        if rest is not None:
            rest.append(left)
        at += len(block)


def _line_start(file, before: int) -> int:
    """First byte of the line that is running at ``before``."""
    while before > 0:
        size = min(_BLOCK, before)
        found = file.read_at(size, before - size).rfind(b"\n")
        if found >= 0:
            return before - size + found + 1
        before -= size
    return 0
