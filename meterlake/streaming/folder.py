"""Watching log files that grow, change or go.

The file source of a stream hands every file out once, so lines appended later
are missed. Here a refresh compares the listing of the folder with the one it
kept, reads the files that are new or changed, and lets their records take the
place of the ones read from them before. Repeats are removed over all records
in (file, position) order at every report, so the result is that of a batch job
over the files as they are, whatever arrived first.

Text is parsed once per file version; a report reads the stored columns. The
table is ``records``, ``files`` and ``commits``, each by version. The commit is
written last: what a crashed refresh has left is no part of the table, and the
next refresh writes it anew. After ``merge_after`` versions all of them become
one, so the number of folders stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlake.operators.dedup import first_per_key
from meterlake.session import remove_folder, stage
from meterlake.sources import claude
from meterlake.sources.lines import read_lines

MERGE_AFTER = 16
FILES_SCHEMA = "_file string, modified bigint, size bigint"


def refresh(spark: SparkSession, path: str, table: str, merge_after: int = MERGE_AFTER) -> bool:
    """Brings the record table up to date with the log files below ``path``; says whether anything changed."""
    base, last = _committed(spark, table)
    known = _files(spark, table, base, last)
    changed = stage(_changes(_listing(spark, path), known))
    oldest = changed.agg(F.min("modified"), F.count("*")).first()
    if not oldest[1]:
        return False
    version = last + 1
    _write_records(spark, path, table, version, changed, oldest[0])
    changed.write.mode("overwrite").parquet(f"{table}/files/version={version}")
    _commit(spark, table, base, version)
    if version - base >= merge_after:
        merge(spark, table)
    return True


def watched_usage(spark: SparkSession, table: str) -> DataFrame:
    """Valid usage of all files as they were at the last refresh; equals ``claude.read`` of them."""
    return claude.valid_usage(first_per_key(_records(spark, table).drop("version"), "dedup_key"))


def start_folder_watch(
    spark: SparkSession,
    path: str,
    table: str,
    checkpoint: str,
    on_refresh: Callable[[DataFrame, int], None],
    every: str = "5 seconds",
) -> StreamingQuery:
    """Refreshes at the given interval, with ``on_refresh(usage, tick)`` when something has changed.

    A stream of ticks is the clock; it carries no data.
    """

    def tick(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if refresh(session, path, table):
            on_refresh(watched_usage(session, table), number)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def merge(spark: SparkSession, table: str) -> None:
    """All versions become one; the old ones are removed after the commit."""
    base, last = _committed(spark, table)
    version = last + 1
    _records(spark, table).drop("version").write.mode("overwrite").parquet(f"{table}/records/version={version}")
    current = _files(spark, table, base, last).select("_file", "modified", "size")
    current.write.mode("overwrite").parquet(f"{table}/files/version={version}")
    _commit(spark, table, version, version)
    for old in range(base, version):
        for part in ("commits", "files", "records"):
            remove_folder(spark, f"{table}/{part}/version={old}")


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """Files with their time and size; the content is not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True)
    try:
        files = reader.load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILES_SCHEMA)
    about = F.col("_metadata")
    return files.select(
        about["file_path"].alias("_file"),
        F.unix_micros(about["file_modification_time"]).alias("modified"),
        about["file_size"].alias("size"),
    )


def _changes(listed: DataFrame, known: DataFrame) -> DataFrame:
    """New and changed files, and with null time and size those that are gone."""
    before = known.select("_file", F.col("modified").alias("_modified"), F.col("size").alias("_size"))
    same = F.col("modified").eqNullSafe(F.col("_modified")) & F.col("size").eqNullSafe(F.col("_size"))
    return listed.join(before, "_file", "full_outer").where(~same).select("_file", "modified", "size")


def _write_records(spark: SparkSession, path: str, table: str, version: int, changed: DataFrame, oldest: int | None) -> None:
    """Records of the changed files. Files older than all of them are not opened."""
    since = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=oldest or 0)
    lines = read_lines(spark, path, "*.jsonl", recursive=True, modified_since=since)
    wanted = changed.where("size IS NOT NULL").select("_file")
    records = claude.records(lines.join(wanted, "_file", "left_semi"))
    records.write.mode("overwrite").parquet(f"{table}/records/version={version}")


def _commit(spark: SparkSession, table: str, base: int, version: int) -> None:
    row = spark.range(1).select(F.lit(base).cast("bigint").alias("base"))
    row.write.mode("overwrite").parquet(f"{table}/commits/version={version}")


def _committed(spark: SparkSession, table: str) -> tuple[int, int]:
    """First version of the table in force and the last one; (0, -1) before the first refresh."""
    try:
        commits = spark.read.schema("base bigint, version bigint").parquet(f"{table}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, -1
    last = commits.where("base IS NOT NULL").agg(F.max(F.struct("version", "base")).alias("last")).first()["last"]
    return (last["base"], last["version"]) if last else (0, -1)


def _files(spark: SparkSession, table: str, base: int, last: int) -> DataFrame:
    """The latest state of each file that still exists, with the version it was read in."""
    if last < 0:
        return spark.createDataFrame([], f"{FILES_SCHEMA}, version bigint")
    versions = spark.read.schema(f"{FILES_SCHEMA}, version bigint").parquet(f"{table}/files")
    latest = versions.where(F.col("version").between(base, last)).groupBy("_file").agg(
        F.max(F.struct("version", "modified", "size")).alias("state"))
    return latest.select("_file", "state.modified", "state.size", "state.version").where("size IS NOT NULL")


def _records(spark: SparkSession, table: str) -> DataFrame:
    """Records of the files in force."""
    base, last = _committed(spark, table)
    if last < 0:
        lines = spark.createDataFrame([], "value string, _file string, _ord bigint")
        return claude.records(lines).withColumn("version", F.lit(0))
    stored = spark.read.parquet(f"{table}/records").where(F.col("version").between(base, last))
    return stored.join(_files(spark, table, base, last).select("_file", "version"), ["_file", "version"], "left_semi")
