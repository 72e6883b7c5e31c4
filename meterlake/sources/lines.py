"""Reading log files as text rows with their position."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_SCHEMA = "value string, _file string, _chunk bigint, _ord bigint"
DOCUMENTS_SCHEMA = "value string, _file string"

_ROW_BITS = 2**33


def read_lines(
    spark: SparkSession, paths: str | list[str], glob: str, recursive: bool = False,
    modified_since: datetime | None = None,
) -> DataFrame:
    """Lines of all matching files: ``value, _file, _chunk, _ord``.

    ``_chunk`` is the byte offset of the input split, so a file of any size is
    cut into chunks of at most ``spark.sql.files.maxPartitionBytes``. ``_ord``
    rises along the file: it is the chunk plus the row number in the task, and
    a task never reads more rows than the split size in bytes.
    """
    reader = spark.read.format("text").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    files = _load(reader, paths)
    if files is None:
        return spark.createDataFrame([], LINES_SCHEMA)
    files = _since(files, modified_since)
    row = F.monotonically_increasing_id() % _ROW_BITS
    return files.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_chunk"),
        (F.col("_metadata.file_block_start") + row).alias("_ord"),
    )


def read_documents(
    spark: SparkSession, paths: str | list[str], glob: str, modified_since: datetime | None = None
) -> DataFrame:
    """Whole files that hold one JSON object each: ``value, _file``."""
    reader = spark.read.format("text").option("pathGlobFilter", glob).option("wholetext", True)
    files = _load(reader, paths)
    if files is None:
        return spark.createDataFrame([], DOCUMENTS_SCHEMA)
    return _since(files, modified_since).select("value", F.col("_metadata.file_path").alias("_file"))


def _load(reader, paths: str | list[str]) -> DataFrame | None:
    """Missing folders are no error: a tool that was never used has no logs."""
    found: DataFrame | None = None
    for path in [paths] if isinstance(paths, str) else list(paths):
        try:
            files = reader.load(path).select("value", "_metadata")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        found = files if found is None else found.unionByName(files)
    return found


def _since(files: DataFrame, moment: datetime | None) -> DataFrame:
    """The test on the file time is applied to the file listing; older files are not opened."""
    if moment is None:
        return files
    moment = moment.astimezone(timezone.utc) if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return files.where(F.col("_metadata.file_modification_time") >= F.lit(moment))


def file_name(path: Column) -> Column:
    return _decoded(F.regexp_extract(path, r"([^/]*)$", 1))


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    return _decoded(F.regexp_extract(path, r"([^/]*)/[^/]*$", 1))


def _decoded(text: Column) -> Column:
    """File paths are URI-encoded; a plus sign stands for itself there."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def json_rows(texts: DataFrame, schema: str, *keep: str) -> DataFrame:
    """The wanted fields of every text in ``value`` that is a JSON object of that shape.

    Fields that are not named are skipped by the parser. Blank lines, other
    JSON and wrong field types are left out. ``inline`` keeps the filters that
    follow above the parser; as plain columns they would be pushed below the
    projection and every text would be parsed a second time.
    """
    record = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return (
        texts.where(F.col("value").rlike(r"^\s*\{"))
        .select(*keep, F.inline(F.array(record)))
        .where(F.col("_corrupt").isNull())
        .drop("_corrupt")
    )


def count_of(value: Column) -> Column:
    """Token counter with default 0."""
    return F.coalesce(value, F.lit(0).cast("bigint"))


def all_counts(*values: Column) -> Column:
    """Counters are unsigned: a negative one makes a record invalid."""
    result = F.lit(True)
    for value in values:
        result = result & (count_of(value) >= 0)
    return result
