"""What several operators share: row keys, shared tables, Arrow helpers, order offsets."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.session import scratch_dir

#: Bytes of text that a task turns into Python objects at a time.
SLICE_CHARS = 8_000_000

#: Bytes of a batch that goes to Python while a table is written.
BATCH_BYTES = 4 << 20

#: Bytes of files for one bucket.
BUCKET_BYTES = 8 << 20


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), the text of a null being empty. Other columns, whatever their names, stay out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_key() -> Column:
    """Key of a row by its content: rows with equal id and text have one key, null ids included."""
    return F.xxhash64("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")


@contextlib.contextmanager
def writing(spark: SparkSession):
    """Settings while a table is written.

    Its shuffle files go when it is complete, batches for Python stay small, and buckets of one file are not sorted again.
    """
    conf = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a cut of the lineage that outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``table``, in ``buckets`` buckets of ``key``: joins on ``key`` with rows in as many partitions do not shuffle it again.

    Spark knows buckets by the catalog only, so the table has a name in the session's, while its files lie in the shared folder.
    """
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    with writing(spark):
        df.repartition(buckets, key).write.option("compression", "zstd").option("path", new_path(spark, name)).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def buckets_of(df: DataFrame) -> int:
    """Buckets for the rows of ``df``: one for about ``BUCKET_BYTES`` of what it reads, as many as Spark allows at most.

    Rows that come from no files have no known size; they get as many buckets as shuffles have partitions.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        return spread(df.sparkSession)
    return min(max(8, -(-size // BUCKET_BYTES)), 100_000)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4()}"


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table made by ``table`` that no later step reads."""
    for file in df.inputFiles()[:1]:
        folder = file[: file.rindex("/")]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        with contextlib.suppress(Exception):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_remembered: dict = {}


def remembered(owner: str, make: Callable):
    """What an operator keeps in a Python worker between its tasks; that of another operator goes."""
    if owner not in _remembered:
        give_back()
        _remembered[owner] = make()
    return _remembered[owner]


def give_back() -> None:
    """Drops what operators have kept in this Python worker, which outlives their stages, and returns its memory."""
    if _remembered:
        _remembered.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)


def spread(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text_col: str = "text", most: int = SLICE_CHARS):
    """(first row, texts as an Arrow array) of a batch, about ``most`` bytes at a time."""
    texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_string())
    if not len(texts):
        return
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.searchsorted(sizes, np.arange(most, int(sizes[-1]) + most, most)) + 1)
    cuts = [0, *np.minimum(cuts, len(texts)).tolist(), len(texts)]
    for first, end in zip(cuts, cuts[1:]):
        if end > first:
            yield first, texts.slice(first, end - first)


def passed_on(batch: pa.RecordBatch, first: int, n: int) -> list[pa.Array]:
    """Columns of some rows as arrays of their own; the JVM cannot read every slice that has nulls only."""
    rows = pa.array(np.arange(first, first + n))
    return [c.take(rows) for c in batch.columns]


def binary_array(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values cut from one flat array; ``ends`` in elements."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * flat.itemsize
    kind = pa.large_binary()
    data = np.ascontiguousarray(flat)
    array = pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return array.cast(pa.binary())


def order_cuts(df: DataFrame, column: str, groups: int) -> list[int]:
    """At most ``groups`` - 1 values of ``column`` that cut it into ranges of about equal size."""
    if groups < 2:
        return []
    shares = [i / groups for i in range(1, groups)]
    found = df.agg(F.percentile_approx(column, shares, F.lit(100 * groups)).alias("cuts")).first()["cuts"]
    return sorted({int(x) for x in found or []})


def range_group(column: Column, cuts: list[int]) -> Column:
    """Number of cuts that are not above the value; null comes first."""
    if not cuts:
        return F.lit(0)
    column = F.coalesce(column, F.lit(-(2**63) + 1))
    return F.size(F.filter(F.expr(f"array({','.join(f'{c}L' for c in cuts)})"), lambda c: c <= column))


def running_start(df: DataFrame, order: list[str], value: str, out: str, groups: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in the order of ``order``.

    The first order column is cut into ranges; each range is summed in a task of
    its own and starts from the sum of the ranges before it. ``df`` is read
    three times, so it should be a small table.
    """
    cuts = order_cuts(df, order[0], groups or 2 * spread(df.sparkSession))
    ranged = df.withColumn("_range", range_group(F.col(order[0]), cuts))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(base), "_range")  # one row for each range, at most ``groups``
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(upto), F.lit(0))).drop("_range", "_base")
