"""Spark session set-up and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "meterlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job in this package relies on.

    Partition counts are left to AQE and to the cluster's own configuration;
    only semantics (UTC, ANSI) and adaptive execution are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are compared and truncated in UTC, whatever the host's zone is."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost together with the executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and reads it back.

    For small intermediate results with several uses: the input is then read
    once, the planner knows the size of the table, and a lost executor costs
    nothing but the tasks it was running.
    """
    path = f"{scratch_dir(df.sparkSession)}/stage-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def subfolders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders directly below those that match, escaped for use as paths of a reader; the files in them are not listed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{pattern.rstrip('/')}/*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", status.getPath().toString()) for status in found if status.isDirectory()]


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder in whatever file system it is; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
