"""Token ids as binary files.

Ids are replaced by their rank of frequency in the corpus, so that common ids
have small numbers, and ranks are stored in one to four whole bytes. The lengths
of four ids share one control byte, and control bytes are kept apart from the
data bytes, so that a reader finds all lengths by one table lookup.

A data set is a folder of Parquet files with one row per document (id, number of
tokens, checksum, control bytes, data bytes), in folders by range of document id,
each sorted by id, and a second folder with the ranks. Spark's writer commits the
files, so a lost executor leaves no half-written ones.

Nulls and ties: a null text is empty; documents with equal ids follow each other
by number of tokens and checksum; a null id comes first. Very long texts are
encoded whole, an empty table gives an empty data set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_array, forget, new_path, order_cuts, running_start, slices, spread, table, texts_of
from .tokens import highest_id, library_encoder, vocabulary_text, with_end

#: Bytes of each of the four numbers under a control byte.
SIZES = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)

FILES = "doc_id long, n_tokens long, crc32 long, control binary, data binary, shard int"


def pack(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes and where each document's end. A document's ids are filled up to whole groups of four."""
    groups = -(-counts // 4)
    first = 4 * (np.cumsum(groups) - groups)
    values = np.zeros(4 * int(groups.sum()), "<u4")
    values[np.arange(len(ids)) + np.repeat(first - (np.cumsum(counts) - counts), counts)] = ids
    sizes = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    control = ((sizes - 1).reshape(-1, 4) @ np.array([1, 4, 16, 64])).astype(np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    ends = np.cumsum(groups)
    return control, ends, data, np.concatenate([[0], np.cumsum(sizes)])[4 * ends]


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All ids of the documents whose bytes are given one after the other."""
    sizes = SIZES[control].reshape(-1)
    start = np.cumsum(sizes) - sizes
    data = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    values = data[start]
    for more in range(1, int(sizes.max(initial=1))):
        values |= np.where(sizes > more, data[start + more], 0).astype(np.uint32) << np.uint32(8 * more)
    groups = -(-counts // 4)
    first = 4 * (np.cumsum(groups) - groups)
    return values[np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)]


def _checksums(ids: np.ndarray, counts: np.ndarray) -> list[int]:
    ids, ends = np.ascontiguousarray(ids, "<u4"), np.cumsum(counts)
    return [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist())]


def encoded(texts: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each text and the end id as plain little-endian numbers."""
    width = "<u2" if max(end, highest_id(vocabulary)) < 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        for batch in batches:
            for first, held in slices(batch):
                ids, counts = with_end(*encoder(held), end)
                columns = [batch.column(0).slice(first, len(held)), pa.array(counts.astype(np.int64)), binary_array(ids.astype(width), np.cumsum(counts))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])

    return texts.mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def _ids(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * int(counts.sum()) else "<u4")


def frequencies(encoded_docs: DataFrame) -> DataFrame:
    """(id, n) over the whole corpus; a task sends one row for each id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in _parts(batch):
                found = np.bincount(_ids(part.column(1), part.column(0).to_numpy(zero_copy_only=False)))
                n = np.concatenate([n, np.zeros(max(0, len(found) - len(n)), np.int64)])
                n[: len(found)] += found
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n[ids], pa.int64())], names=["id", "n"])

    return encoded_docs.select("n_tokens", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, len(batch), rows))


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str | None = None, end: int = 2) -> None:
    """Writes the ids of every document below ``path``, in ascending order of document id."""
    spark, texts = docs.sparkSession, texts_of(docs)
    coded = table(encoded(texts, vocabulary_text(vocabulary_path), end), "token-ids")
    counted = frequencies(coded).collect()  # one row for each id of the vocabulary at most
    order = sorted(counted, key=lambda r: (-r["n"], r["id"]))
    spark.createDataFrame([(r["id"], i) for i, r in enumerate(order)], "id long, rank long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max((r["id"] for r in order), default=0) + 1, np.uint32)
    rank[[r["id"] for r in order]] = np.arange(len(order))
    cuts = np.array(order_cuts(coded, "doc_id", spread(spark)), np.int64)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                keys, counts = part.column(0), part.column(1).to_numpy(zero_copy_only=False)
                ids = _ids(part.column(2), counts)
                control, control_ends, data, data_ends = pack(rank[ids], counts)
                shard = np.searchsorted(cuts, keys.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
                columns = [keys, part.column(1), pa.array(_checksums(ids, counts), pa.int64()), binary_array(control, control_ends), binary_array(data, data_ends), pa.array(shard)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "crc32", "control", "data", "shard"])

    rows = coded.mapInArrow(rewrite, FILES).repartition(spread(spark), "shard")
    rows.sortWithinPartitions("shard", "doc_id", "n_tokens", "crc32").write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/ids")
    forget(spark, coded)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids), or with ``digest`` (doc_id, n_tokens, ids_crc32) without moving the ids to the JVM."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # one row for each id of the vocabulary at most
    ids_by_rank = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        ids_by_rank[r["rank"]] = r["id"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                counts = part.column(1).to_numpy(zero_copy_only=False)
                control, data = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8) for c in (2, 3))
                ids = ids_by_rank[unpack(control, data, counts)].astype("<u4")
                if digest:
                    last = pa.array(_checksums(ids, counts), pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), last], names=["doc_id", "n_tokens", "ids_crc32" if digest else "ids"])

    stored = spark.read.schema(FILES).parquet(f"{path}/ids").select("doc_id", "n_tokens", "control", "data")
    return stored.mapInArrow(decode, f"doc_id long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")


def token_files(docs: DataFrame, vocabulary_path: str | None = None, end: int = 2) -> DataFrame:
    """Writes the ids of ``docs``, reads the files back and returns (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before this one in the files.
    """
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_tokens(docs, path, vocabulary_path, end)
    read = table(read_tokens(spark, path, digest=True), "token-digests")
    placed = running_start(read, ["doc_id", "n_tokens", "ids_crc32"], "n_tokens", "start")
    return placed.select("doc_id", F.col("start").cast("long"), "n_tokens", "ids_crc32")
