"""Vector codes by a product quantizer whose entries are found by Orchard search.

Vectors become integers ``floor(scale * x)`` and are cut into ``PARTS`` equal
consecutive parts, each with a codebook of up to ``ENTRIES`` entries. Codebooks start as the
parts of the least ids. In each round every part goes to its nearest entry
(squared Euclidean distance, ties to the lower index), and each entry becomes the
componentwise floor of the mean of its parts; unused entries stay.

The nearest entry is found by Orchard search. Every entry has a list of all
entries by distance from it. The search walks the list of its best entry so far
and looks at each entry not yet marked as visited; a nearer one becomes the best,
and the walk goes on in its list. It stops where the list is farther from the best entry
than twice the distance of the vector from it: by the triangle inequality
nothing behind can be as near. All parts of a batch walk in step, a few list places at a time.

Everything is exact integer arithmetic. A round is one pass over the vectors:
each task returns a sum and a count per entry, Spark adds them up, and the driver gets
the codebooks only, whose size is fixed by ``ENTRIES`` and the length of a vector.

Nulls and ties: vectors that are null or hold null or non-finite components are
dropped. A null id comes behind all others; vectors with equal ids are ordered by
their components. Vectors of each length have codebooks of their own; a length that 4 does not divide
gives parts that differ by one component. Repeated rows all count. A vector whose
squared distances might not fit into 64 bits (components beyond about 10^5) is an
error, as there is no exact result in the columns. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

#: Vectors searched in step, and places of their lists looked at together.
STEP, AHEAD = 4096, 8

#: Codebooks of the vectors of one length: an integer array (entries, components) for each part.
Books = list[np.ndarray]


def cuts(dim: int) -> list[int]:
    return [dim * p // PARTS for p in range(PARTS + 1)]


class Orchard:
    """Neighbour lists of a codebook."""

    def __init__(self, book: np.ndarray):
        self.book = book
        gaps = np.array([((book - entry) ** 2).sum(axis=1) for entry in book])
        self.lists = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.lists, axis=1)
        # ends of the lists, so that a few places can always be read
        self.lists = np.pad(self.lists, ((0, 0), (0, AHEAD)), mode="edge")
        self.gaps = np.pad(self.gaps, ((0, 0), (0, AHEAD)), constant_values=np.iinfo(np.int64).max)
        order = np.argsort(book.sum(axis=1), kind="stable")
        self.by_sum, self.sums = order, book.sum(axis=1)[order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row."""
        n, last = len(x), len(self.book) - 1
        best = self.by_sum[np.minimum(np.searchsorted(self.sums, x.sum(axis=1)), last)]
        distance = ((x - self.book[best]) ** 2).sum(axis=1)
        visited = np.zeros((n, last + 1), bool)
        visited[np.arange(n), best] = True
        place, active = np.zeros(n, np.int64), np.arange(n)
        ahead = np.arange(AHEAD)
        while len(active):
            of, at = best[active], place[active][:, None] + ahead
            gaps = self.gaps[of[:, None], at]
            # halved roots: gap > 4 * distance, without overflow
            within = (gaps - 1) // 4 < distance[active][:, None]
            entries = self.lists[of[:, None], at]
            new = within & ~visited[active[:, None], entries]
            row, column = np.nonzero(new)
            chosen = entries[row, column]
            visited[active[row], chosen] = True
            found = ((x[active[row]] - self.book[chosen]) ** 2).sum(axis=1)
            order = np.lexsort((chosen, found, row))
            row, chosen, found = row[order], chosen[order], found[order]
            first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            row, chosen, found = row[first], chosen[first], found[first]
            better = (found < distance[active[row]]) | ((found == distance[active[row]]) & (chosen < of[row]))
            row, chosen, found = row[better], chosen[better], found[better]
            place[active] += AHEAD
            best[active[row]], distance[active[row]], place[active[row]] = chosen, found, 0
            going = within[:, -1]  # gaps rise along a list
            going[row] = True
            active = active[going]
        return best, distance


def sound(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, label, vector, dim) of the vectors that are kept."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False))).withColumn("dim", F.size("vector"))


def _scaled(batch: pa.RecordBatch, column: str = "vector") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, integer vectors) for each length and at most ``STEP`` vectors."""
    lists = batch.column(batch.schema.get_field_index(column))
    dims = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        of_length = np.flatnonzero(dims == dim)
        for at in range(0, len(of_length), STEP):
            places = of_length[at : at + STEP]
            flat = lists.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
            scaled = np.floor(flat * SCALE)
            if len(scaled) and np.abs(scaled).max() >= np.sqrt(2.0**60 / dim):
                raise ValueError("components are too large for exact squared distances in 64 bits")
            yield int(dim), places, scaled.astype(np.int64).reshape(len(places), int(dim))


def first_books(kept: DataFrame) -> dict[int, Books]:
    """The vectors of the least ids of each length, cut into parts."""
    books = {}
    for dim in sorted(r["dim"] for r in kept.select("dim").distinct().collect()):
        least = kept.where(F.col("dim") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES)
        rows = pa.RecordBatch.from_pylist([{"vector": r["vector"]} for r in least.collect()], pa.schema([("vector", pa.list_(pa.float64()))]))
        start = np.concatenate([x for _, _, x in _scaled(rows)])
        books[dim] = [start[:, a:b] for a, b in zip(cuts(dim), cuts(dim)[1:])]
    return books


def next_books(kept: DataFrame, books: dict[int, Books]) -> dict[int, Books]:
    """One round: sums of the parts of each entry, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {dim: [Orchard(b) for b in parts] for dim, parts in books.items()}
        sums = {dim: [np.zeros_like(b) for b in parts] for dim, parts in books.items()}
        counts = {dim: [np.zeros(len(b), np.int64) for b in parts] for dim, parts in books.items()}
        for batch in batches:
            for dim, _, x in _scaled(batch):
                for p, (a, b) in enumerate(zip(cuts(dim), cuts(dim)[1:])):
                    found, _ = searches[dim][p].nearest(x[:, a:b])
                    np.add.at(sums[dim][p], found, x[:, a:b])
                    counts[dim][p] += np.bincount(found, minlength=len(counts[dim][p]))
        for dim, parts in counts.items():
            for p, n in enumerate(parts):
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array([dim] * len(used), pa.int64()), "part": pa.array([p] * len(used), pa.int64()),
                    "entry": pa.array(used), "n": pa.array(n[used]), "sums": pa.array(sums[dim][p][used].tolist(), pa.list_(pa.int64()))})

    found = kept.select("vector").mapInArrow(run, "dim long, part long, entry long, n long, sums array<long>")
    counted = found.select("dim", "part", "entry", "n", F.posexplode_outer("sums").alias("place", "value"))
    sums = counted.groupBy("dim", "part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(19,0)")).alias("total"), F.sum("n").alias("n"))
    means = sums.withColumn("mean", F.expr("(total - pmod(total, n)) div n"))
    new = {dim: [b.copy() for b in parts] for dim, parts in books.items()}
    for r in means.where("place IS NOT NULL").collect():  # as many as the codebooks have components
        new[r["dim"]][r["part"]][r["entry"], r["place"]] = r["mean"]
    return new


def train(kept: DataFrame, rounds: int = ROUNDS) -> dict[int, Books]:
    books = first_books(kept)
    for _ in range(rounds if books else 0):
        books = next_books(kept, books)
    return books


def encode(kept: DataFrame, books: dict[int, Books]) -> DataFrame:
    """(vec_id, label, dim, code, error) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {dim: [Orchard(b) for b in parts] for dim, parts in books.items()}
        for batch in batches:
            codes, errors = np.zeros((len(batch), PARTS), np.uint8), np.zeros(len(batch), np.int64)
            for dim, places, x in _scaled(batch):
                for p, (a, b) in enumerate(zip(cuts(dim), cuts(dim)[1:])):
                    codes[places, p], distance = searches[dim][p].nearest(x[:, a:b])
                    errors[places] += distance
            names = ["vec_id", "label", "dim"]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], names=[*names, "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "dim", "vector").mapInArrow(run, f"vec_id long, label {label}, dim int, code string, error long")


def decode(codes: str, books: Books) -> list[float]:
    """The vector that a code stands for."""
    return [float(v) / SCALE for part, book in zip(bytes.fromhex(codes), books) for v in book[part]]


def books_sha256(books: Books) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label"
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept."""
    kept = sound(vectors, id_col, vector_col, label_col)
    books = train(kept)
    coded = table(encode(kept, books), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    digest = F.lit(None).cast("string")
    for dim, own in books.items():
        digest = F.when(F.col("dim") == dim, F.lit(books_sha256(own))).otherwise(digest)
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
