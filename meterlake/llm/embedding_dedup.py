"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits space again and again by a random direction at the median of a
bounded sample. Points near a split go to both sides (spill), so that a close
pair is seldom parted, and several trees make a miss unlikely. All vectors are
dealt to their leaves; pairs are compared within leaves only, in double
precision, and the links found are joined into components.

Equal vectors are one node with a count. Vectors carry the codes of all their
leaves, so that a pair that meets in several leaves counts in the first one only.
A leaf returns for each vector its number of new links and one edge to the least
vector that its links reach there, never pairs. Leaves with more than ``BLOCK``
vectors are dealt in blocks, a task for each pair of blocks.

Nulls and ties: vectors that are null, zero, of another length than the most
frequent one, or that hold null or non-finite components link with nothing; a null
id counts as a vector of its own. Repeated rows link with each other. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .graph import components

#: Distinct vectors that the trees are fitted on at most, those with the least hash.
SAMPLE = 8_000

TREES, LEAF, BLOCK = 6, 256, 1024

#: Half of the spill zone, as a share of the standard deviation of the projected distance of a pair at the threshold.
SPILL = 0.5


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Directions and thresholds of all trees; their size depends on the sample only."""

    def __init__(self, sample: np.ndarray, count: int, threshold: float, seed: int = 11):
        generator = np.random.Generator(np.random.PCG64(seed))
        n, dim = sample.shape
        deepest = max(0, int(np.log2(max(1, n))) - 1)
        self.depth = min(deepest, max(0, int(np.ceil(np.log2(max(1, count) / LEAF)))))
        self.margin = SPILL * np.sqrt(2 - 2 * threshold) / np.sqrt(max(1, dim))
        self.trees = []
        for _ in range(TREES):
            levels, members = [], {0: np.arange(n)}
            for level in range(self.depth):
                directions = unit(generator.standard_normal((1 << level, dim)))
                cuts, below = np.zeros(1 << level), {}
                for node, rows in members.items():
                    p = sample[rows] @ directions[node]
                    cuts[node] = np.median(p) if len(p) else 0.0
                    below[2 * node], below[2 * node + 1] = rows[p <= cuts[node]], rows[p > cuts[node]]
                levels.append((directions, cuts))
                members = below
            self.trees.append(levels)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) of every leaf that each row falls into, sorted; codes are unique over the trees."""
        rows, codes = [], []
        for t, levels in enumerate(self.trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for directions, cuts in levels:
                gap = np.einsum("ij,ij->i", x[row], directions[node]) - cuts[node]
                left, right = gap <= self.margin, gap > -self.margin
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            codes.append(node + (t << self.depth))
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        return row[order], code[order]


def fit(nodes: DataFrame, threshold: float) -> Forest:
    """A forest from at most ``SAMPLE`` vectors, for as many as ``nodes`` has."""
    count = nodes.count()
    some = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").collect()
    sample = unit(np.array([r["vector"] for r in some], np.float64)) if some else np.zeros((0, 1))
    return Forest(sample, count, threshold)


def deal(nodes: DataFrame, forest: Forest) -> DataFrame:
    """(code, node, n, vector, codes): a row for each leaf of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = flat.reshape(len(part), -1)
                exact = bool((flat.astype(np.float32).astype(np.float64) == flat).all())
                row, code = forest.leaves(unit(x))
                bodies = [v.astype(np.float32 if exact else np.float64).tobytes() for v in x]
                ends = np.cumsum(np.bincount(row, minlength=len(x)))
                own = [code[a:b].astype(np.int32).tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
                which = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(code), part.column(0).take(which), part.column(1).take(which), pa.array(bodies, pa.binary()).take(which), pa.array(own, pa.binary()).take(which)], names=["code", "node", "n", "vector", "codes"])

    return nodes.select("node", "n", "vector").mapInArrow(run, "code long, node long, n long, vector binary, codes binary")


def compare(dealt: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b, links): for each vector of a leaf that has new links there, the least vector they reach, and their number."""
    sizes = dealt.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = dealt.join(sizes, "code").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = placed.select("code", "node", "n", "vector", "codes", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grouped = pairs.select("code", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node", "n", "vector", "codes")

    def link(key, group):
        code, across = key[0].as_py(), key[1].as_py() != key[2].as_py()
        nodes = group.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")
        nodes, counts, sides = nodes[order], group.column("n").to_numpy()[order], group.column("mine").to_numpy()[order]
        raw, paths = group.column("vector").to_pylist(), group.column("codes").to_pylist()
        x = np.array([np.frombuffer(raw[i], np.float32 if len(raw[i]) == 4 * dim else np.float64).astype(np.float64) for i in order])
        x /= np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        linked = x @ x.T >= threshold * (norm[:, None] * norm)
        linked &= linked.T
        np.fill_diagonal(linked, False)
        if across:
            linked &= sides[:, None] != sides
        if linked.any():
            before = [np.frombuffer(paths[i], np.int32) for i in order]
            before = [p[p < code] for p in before]
            of = np.repeat(np.arange(len(before)), [len(p) for p in before])
            if len(of):  # pairs that have met in an earlier leaf
                _, at = np.unique(np.concatenate(before), return_inverse=True)
                have = np.zeros((len(before), int(at.max()) + 1), np.float32)
                have[of, at] = 1
                linked &= (have @ have.T) == 0
        i, j = np.nonzero(linked)
        root = _roots(len(nodes), i, j)
        some = np.flatnonzero(linked.any(axis=1))
        return pa.table({"a": nodes[some], "b": nodes[root[some]], "links": (linked @ counts)[some].astype(np.int64)})

    return grouped.groupBy("code", "x", "y").applyInArrow(link, "a long, b long, links long")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable place of each, by passing the least on until nothing changes."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    often = rows.where("sound").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = often["dim"] if often else 0
    # -0.0 equals 0.0
    plain = F.transform("vector", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))
    noded = rows.withColumn("node", F.when(F.col("sound") & (F.size("vector") == dim), F.xxhash64(plain)))
    nodes = table(noded.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")), "vectors")
    met = table(compare(deal(nodes, fit(nodes, threshold)), dim, threshold), "leaf-links")
    links = met.groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(met).select("node", "component")
    full = nodes.select("node", "n", "least").join(links.withColumnRenamed("a", "node"), "node", "left").join(joined, "node", "left")
    full = table(full.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least", F.coalesce("component", "node").alias("component")), "vector-links")
    least = full.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = noded.select("vec_id", "node").join(full.join(least, "component").select("node", "n_links", "component_id"), "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return answer.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
