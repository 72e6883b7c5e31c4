"""Packing of documents into sequences of a fixed number of tokens by column generation.

Documents are cut into full sequences and a rest. Only the histogram of the
rests, in classes of ``unit`` tokens, reaches the driver: its size depends on the
sequence length, not on the corpus. There a linear program chooses how often each
pattern (a multiset of classes that fits a sequence) is used. Patterns come from
column generation: the dual prices of the program in hand are the values in an
unbounded knapsack, solved by dynamic programming, and its best filling joins the
program while it lowers the number of sequences. The solution is rounded down and
first-fit on the histogram covers what is left.

The result is a table of places: class, ranks from-to, and the sequence of the
first rank. Pieces are ranked within their class in order of document, without a
task that holds a class: ranks are counted within ranges of documents, and each
range starts from the counts of those before it. A broadcast join with the places
(their number depends on the classes only) gives each piece its sequence.

A null text is empty and is packed as its end id; repeated and null ids keep all
their rows; texts of any length are cut; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import order_cuts, range_group, slices, spread, table, texts_of
from .tokens import library_encoder, vocabulary_text, with_end


def solve(demand: np.ndarray, room: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that every class is covered exactly. Class w needs w units of ``room``."""
    sizes = np.flatnonzero(demand)
    wanted = demand[sizes].astype(float)
    m = len(sizes)
    if not m:
        return []
    patterns = [np.where(np.arange(m) == i, room // sizes[i], 0).astype(float) for i in range(m)]
    inverse = np.diag([1 / p[i] for i, p in enumerate(patterns)])
    amount = inverse @ wanted
    for _ in range(rounds):
        price = inverse.sum(axis=0)  # every pattern costs one sequence
        column = _knapsack(price, sizes, room)
        if price @ column <= 1 + 1e-7:
            break
        way = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-9, amount / way, np.inf)
        out = int(np.argmin(ratio))
        amount = amount - ratio[out] * way
        amount[out] = ratio[out]
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        patterns[out] = column
    used, left = [], wanted.astype(np.int64).copy()
    for pattern, x in sorted(zip(patterns, amount), key=lambda p: -p[1]):
        counts = pattern.astype(np.int64)
        often = min(int(np.floor(x + 1e-6)), *(int(left[i] // counts[i]) for i in np.flatnonzero(counts)))
        if often > 0:
            used.append((_by_class(counts, sizes, room), often))
            left -= often * counts
    while left.any():  # first fit of the largest classes
        counts, free = np.zeros(m, np.int64), room
        for i in range(m - 1, -1, -1):
            counts[i] = min(left[i], free // sizes[i])
            free -= counts[i] * sizes[i]
        often = int(min(left[i] // counts[i] for i in np.flatnonzero(counts)))
        used.append((_by_class(counts, sizes, room), often))
        left -= often * counts
    return used


def _by_class(counts: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    full = np.zeros(room + 1, np.int64)
    full[sizes] = counts
    return full


def _knapsack(value: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The most valuable filling of ``room``, any number of each item."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for free in range(1, room + 1):
        fits = sizes <= free
        gain = np.where(fits, value + best[free - np.where(fits, sizes, 0)], -1)
        i = int(np.argmax(gain))
        best[free], took[free] = best[free - 1], -2
        if gain[i] > best[free] + 1e-12:
            best[free], took[free] = gain[i], i
    counts, free = np.zeros(len(sizes)), room
    while free > 0 and took[free] != -1:
        if took[free] == -2:
            free -= 1
        else:
            counts[took[free]] += 1
            free -= sizes[took[free]]
    return counts


def pieces(docs: DataFrame, vocabulary_path: str | None, end: int, length: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full sequences and the rest of every document."""
    vocabulary = vocabulary_text(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        for batch in batches:
            for first, held in slices(batch):
                ids, counts = with_end(*encoder(held), end)
                parts = -(-counts // length)
                of = np.repeat(np.arange(len(counts)), parts)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
                size = np.minimum(counts[of] - start, length)
                place = (np.cumsum(counts) - counts)[of] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(place.tolist(), size.tolist())]
                columns = [batch.column(0).slice(first, len(held)).take(pa.array(of)), *(pa.array(x, pa.int64()) for x in (start, size, crc, counts[of]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts_of(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, vocabulary_path: str | None = None, end: int = 1, length: int = 2048, unit: int = 8) -> DataFrame:
    """A row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Pieces of a document are its full sequences and one rest. ``offset`` counts
    from 0 in each sequence without gaps. Sequence ids have no gaps either.
    """
    spark = docs.sparkSession
    if length % unit:
        raise ValueError("the sequence length must be a multiple of unit")
    cut = table(pieces(docs, vocabulary_path, end, length), "pieces")
    cuts = order_cuts(cut, "doc_id", 2 * spread(spark))
    classed = cut.withColumn("_class", F.ceil(F.col("length") / unit).cast("int")).withColumn("_range", range_group(F.col("doc_id"), cuts))
    counts = table(classed.groupBy("_class", "_range").agg(F.count("*").alias("_n")), "piece-counts")
    total = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}  # at most length / unit rows
    room = length // unit
    demand = np.zeros(room + 1, np.int64)
    for k, n in total.items():
        demand[k] = n
    full, demand[room] = int(demand[room]), 0
    places, sequences, given = [(room, 0, full, 0, 0)] if full else [], full, np.zeros(room + 1, np.int64)
    for pattern, often in solve(demand, room):
        slot = 0
        for k in np.flatnonzero(pattern)[::-1].tolist():
            for _ in range(int(pattern[k])):
                places.append((k, int(given[k]), int(given[k]) + often, sequences, slot))
                given[k] += often
                slot += 1
        sequences += often
    placed = spark.createDataFrame(places, "_class int, _from long, _to long, _first long, _slot int").coalesce(1)
    # the counts have a row for each class and range; their running sum is kept within a class
    before = Window.partitionBy("_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_class", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_class", "_range").orderBy(F.col("doc_id").asc_nulls_first(), "start", "ids_crc32")
    ranked = classed.withColumn("_nth", F.row_number().over(within) - 1).join(base, ["_class", "_range"]).withColumn("_rank", F.col("_nth") + F.col("_base"))
    p = F.broadcast(placed)  # at most a few thousand rows, whatever the corpus
    met = ranked.alias("r").join(p.alias("p"), (F.col("r._class") == F.col("p._class")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    row = met.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "_slot")
    ahead = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return row.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))
