"""Similarity join on word n-gram sets by vertical partitioning.

N-grams are ordered by a hash, and that order is cut into fragments. Two sets with
a Jaccard similarity of at least the threshold differ in a bounded number of
elements, hence in at most as many fragments; with more fragments than that, some
fragment is equal on both sides. So each set sends a digest of each fragment, and
sets with an equal digest meet, whatever they share otherwise. There are spare
fragments, and each set leaves out as many digests, those that the most sets
have: a fragment that lies within a passage of very many documents brings
together only sets that have little else. The number of fragments depends on the set's size, in steps of
1 / threshold; a set takes part in its own step and in the one below, so that sets
of two neighbouring steps are compared by the same fragments.

Sets that meet are linked in a star around the least one, stars are joined into
classes of candidates, and within a class overlaps are counted inside a task, a bounded
number of n-gram occurrences after the other, for pairs that no chain of
links joins yet; they are not summed per pair by Spark, which would emit all pairs of a large class. N-grams that only one set of a class has cannot add to an overlap
and are left out. Large classes are dealt in blocks of sets, a task for each pair
of blocks.

Texts with equal sets are one set. Its documents share its class.

Nulls and ties: a null text or one without words has an empty set, which is linked
with nothing; a text with fewer words than n is one n-gram; repeated rows are
linked with each other; a null id counts as a document of its own, and as the
least of its class if there is no other. An empty table gives no rows. Texts are
read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_array, give_back, mix, row_key, slices, table, texts_of
from .graph import components

#: N-grams and sets in a block of a class.
BLOCK_GRAMS, BLOCK_SETS = 1_500_000, 8192

#: Occurrences of n-grams that are counted at a time.
FRAGMENT = 1 << 20

#: Bytes of text whose n-grams are in memory at a time.
SLICE = 1_000_000


#: Moves A-Z to a-z in UTF-8 bytes and every white space to a blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of each text, sorted, one text after the other, and where each ends."""
    raw = [t.as_buffer().to_pybytes().translate(_PLAIN).decode() if t.is_valid else "" for t in texts]
    pieces = pc.ascii_split_whitespace(pa.array(raw, pa.large_string()))
    flat = pieces.flatten()
    flat_valid = pc.not_equal(flat, "")
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))])
    full = flat_valid.to_numpy(zero_copy_only=False)
    counts = np.diff(np.concatenate([[0], np.cumsum(full)])[offsets])
    coded = flat.filter(flat_valid).dictionary_encode()
    names = coded.dictionary.to_pylist()
    numbers = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    words = numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    h = np.zeros(len(words), np.uint64)
    begin = np.repeat(ends - counts, counts)
    here = np.arange(len(words))
    stop = np.repeat(ends, counts)
    for k in range(n):
        at = here + k
        inside = at < stop
        h[inside] = mix(h[inside] * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(at, max(len(words) - 1, 0))[inside]])
    first = (here == begin) & (stop - begin < n)
    keep = (here + n <= stop) | first
    h, of = h[keep], np.repeat(np.arange(len(counts)), counts)[keep]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
        h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(counts)), side="right")


def most_differences(total: int, threshold: Fraction) -> int:
    """Elements in which two sets of together ``total`` elements may differ: total - 2 * overlap."""
    return total - 2 * math.ceil(total * threshold / (1 + threshold))


class Steps:
    """Size steps and their numbers of fragments."""

    def __init__(self, threshold: Fraction):
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, math.floor(self.bounds[-1] / threshold) + 1))
        # step s is met by sets of bounds[s] <= size < bounds[s + 1], and the larger partners of those
        self.fragments, self.spares = [], []
        for s in range(len(self.bounds) - 1):
            small = self.bounds[s + 1] - 1
            total = small + math.floor(small / threshold)
            differ = max(most_differences(t, threshold) for t in range(max(2, total - 3), total + 1))
            self.spares.append(1 + differ // 6 if differ else 0)
            self.fragments.append(differ + 1 + self.spares[-1])

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.bounds), sizes, side="right") - 1


def signatures(h: np.ndarray, ends: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, digest, mark): a digest of each fragment that has elements, in a set's step and the one below.

    ``mark`` is 4 * the number of digests that may be left out + 2 * (step below)
    + (empty fragment). Empty fragments are the first to be left out: if there are
    at most as many as spare ones, they are not sent, and as many others fewer may be
    left out; if there are more, they are sent, as two similar sets could
    have only empty ones in common, and only empty ones may be left out.
    """
    sizes = np.diff(ends, prepend=0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    own = steps.of(np.maximum(sizes, 1))
    outs = []
    fragments, spares = np.array(steps.fragments, np.int64), np.array(steps.spares, np.int64)
    high = (h >> np.uint64(32)).astype(np.int64)
    mixed = mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    for below in (0, 1):
        step = own - below
        valid = (step >= 0) & (sizes > 0)
        parts = np.where(valid, fragments[np.maximum(step, 0)], 0)
        base = np.cumsum(parts) - parts
        total = int(parts.sum())
        if not total:
            continue
        chosen = valid[of]
        slot = base[of[chosen]] + ((high[chosen] * parts[of[chosen]]) >> 32)
        value, count = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
        np.add.at(value, slot, mixed[chosen])
        owner = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(total) - base[owner]
        empty = np.bincount(owner[count == 0], minlength=len(sizes))
        spare = spares[np.maximum(step, 0)]
        many = empty > spare
        send = (count > 0) | many[owner]
        digest = mix(mix(value + count.astype(np.uint64)) + (nth.astype(np.uint64) << np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15) + step[owner].astype(np.uint64))
        left_out = np.where(count == 0, spare[owner], np.maximum(spare - empty, 0)[owner])
        mark = 4 * left_out + 2 * below + (count == 0)
        outs.append((owner[send], digest[send], mark[send].astype(np.int32)))
    if not outs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*outs))


def _identity(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(1)), dtype=np.uint64)])[np.concatenate([[0], ends])]
    sizes = np.diff(ends, prepend=0)
    return np.where(sizes > 0, mix(np.diff(sums) + sizes.astype(np.uint64)), 0).astype(np.uint64).view(np.int64)


def describe(keyed: DataFrame, n: int) -> DataFrame:
    """(row, doc_id, n_shingles, set): size and digest of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for first, held in slices(batch, most=SLICE):
                h, ends = shingle_sets(held, n)
                part = batch.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(ends, prepend=0).astype(np.int64)), pa.array(_identity(h, ends))], names=["row", "doc_id", "n_shingles", "set"])

    return keyed.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_shingles long, set long")


def meetings(keyed: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(a, b): sets with an equal fragment, as stars around the least set of each fragment."""
    steps = Steps(threshold)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for _, held in slices(batch, most=SLICE):
                h, ends = shingle_sets(held, n)
                ids = _identity(h, ends)
                distinct = np.zeros(len(ids), bool)
                distinct[np.unique(ids, return_index=True)[1]] = True
                of, digest, mark = signatures(h, ends, steps)
                kept = distinct[of]
                columns = [pa.array(digest[kept].view(np.int64)), pa.array(ids[of[kept]]), pa.array(mark[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "set", "mark"])

    sent = keyed.select("text").mapInArrow(send, "digest long, set long, mark int")
    often = sent.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    shared = sent.join(often, "digest").distinct()
    # Similar sets have more fragments in common than either leaves out. Both leave out their first ones in one order (empty ones,
    # then by frequency), so the last one in common is left out by neither. Digests of one set only come last and change no rank.
    order = Window.partitionBy("set", F.expr("mark & 3")).orderBy(F.desc("n"), "digest")
    kept = table(shared.withColumn("_nth", F.row_number().over(order)).where("_nth > mark >> 2").select("digest", "set"), "fragments")
    # the least set of a fragment is a partial aggregate; the join back can be split at hot fragments
    least = kept.groupBy("digest").agg(F.min("set").alias("b"), F.max("set").alias("top")).where("b < top").select("digest", "b")
    return kept.join(least, "digest").where("set > b").select(F.col("set").alias("a"), "b").distinct()


def dealt(classes: DataFrame) -> DataFrame:
    """Adds to (row, set, class, n) the number of blocks of the class and the block of the set.

    A block has about ``BLOCK_GRAMS`` n-grams and ``BLOCK_SETS`` sets, so a task
    needs the same memory whether sets are many or long.
    """
    most = F.greatest(F.sum("n") / BLOCK_GRAMS, F.count("*") / BLOCK_SETS)
    sizes = classes.groupBy("class").agg(F.ceil(most).cast("int").alias("blocks"))
    return classes.join(sizes, "class").withColumn("mine", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))


def verified(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): links that join the similar sets of each class of candidates.

    ``sets`` has (class, blocks, mine, set, hashes). Each pair of blocks is one
    group. Within a group a link between sets that are joined already is not
    returned, so there are fewer links than sets.
    """
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = pairs.select("class", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "set", "hashes")

    def link(key, group):
        ids = group.column("set").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        found = group.column("hashes").to_pylist()
        hashes = [np.frombuffer(found[i], np.uint64) for i in order]
        sides = group.column("mine").to_numpy()[order]
        x, y = key[1].as_py(), key[2].as_py()
        a, b = _links(hashes, threshold, None if x == y else sides)
        return pa.table({"a": ids[a].astype(np.int64), "b": ids[b].astype(np.int64)})

    return grouped.groupBy("class", "x", "y").applyInArrow(link, "a long, b long")


def _links(sets: list[np.ndarray], threshold: Fraction, sides: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of similar pairs that make a spanning forest; with ``sides`` only pairs of two sides count.

    One set after the other is compared with all sets that share n-grams with it,
    until every set outside the largest component has been. Two sets of different
    components have then been compared, and the members of a large group of copies
    need not be compared with each other.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(new)
    times = np.diff(begin, append=len(flat))
    gram = np.empty(len(flat), np.int32)
    gram[order] = np.cumsum(new, dtype=np.int32) - 1
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)[order]
    del flat, ordered, new, order
    own = np.concatenate([[0], np.cumsum(sizes)])
    p, q = threshold.numerator, threshold.denominator
    label, waiting, left, right = np.arange(m), np.ones(m, bool), [], []
    while True:
        rest = np.flatnonzero(waiting & (label != np.argmax(np.bincount(label, minlength=m))))
        if not len(rest):
            break
        i = int(rest[0])
        waiting[i] = False
        mine = gram[own[i] : own[i + 1]]
        mine = mine[times[mine] > 1]
        both = np.zeros(m, np.int64)
        total = np.cumsum(times[mine])
        cuts = np.searchsorted(total, np.arange(FRAGMENT, int(total[-1]) if len(total) else 0, FRAGMENT))
        for part in np.split(mine, np.unique(cuts)):  # one fragment of the n-gram order after the other
            counts = times[part]
            at = np.arange(int(counts.sum())) + np.repeat(begin[part] - (np.cumsum(counts) - counts), counts)
            both += np.bincount(owner[at], minlength=m)
        similar = (both > 0) & (q * both >= p * (sizes[i] + sizes - both)) & (label != label[i])
        if sides is not None:
            similar &= sides != sides[i]
        j = np.flatnonzero(similar)
        joined, at = np.unique(label[j], return_index=True)
        if len(joined):
            left += [i] * len(joined)
            right += j[at].tolist()
            label[np.isin(label, joined)] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def candidate_sets(keyed: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(class, blocks, mine, set, hashes) of every set that has a candidate. ``classes`` has a row for each set."""
    names = ["class", "blocks", "mine", "set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for first, held in slices(batch, most=SLICE):
                h, ends = shingle_sets(held, n)
                part = batch.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], binary_array(h, ends)], names=[*names, "hashes"])

    # the same plan at every size: the classes grow with the texts, so they are never broadcast
    met = keyed.join(classes.hint("merge"), "row").select(*names, "text")
    return met.mapInArrow(run, "class long, blocks int, mine int, set long, hashes binary")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """(row, doc_id, n_shingles, component_id, class): documents linked by n-gram similarity.

    ``component_id`` is the least document id that links reach, ``row`` the key
    of the document's id and text, ``class`` the number of the group, whatever its ids; it is null for an empty set.
    """
    threshold = Fraction(threshold)
    keyed = texts_of(docs).withColumn("row", row_key())
    described = table(describe(keyed, n), "sets")
    met = table(meetings(keyed, n, threshold), "meetings")
    candidates = components(met).select(F.col("node").alias("set"), F.col("component").alias("class"))
    # one row, the one with the least key, stands for all texts of a set
    first = described.where("n_shingles > 0").groupBy("set").agg(F.min("row").alias("row"), F.max("n_shingles").alias("n"))
    classes = dealt(table(candidates.join(first, "set"), "candidates"))
    links = table(verified(candidate_sets(keyed, classes, n), threshold), "links")
    joined = components(links).select(F.col("node").alias("set"), "component")
    classed = described.join(joined, "set", "left").withColumn("_class", F.when(F.col("n_shingles") > 0, F.coalesce("component", "set")))
    least = classed.where("_class IS NOT NULL").groupBy("_class").agg(F.min("doc_id").alias("_least"))
    return classed.join(least, "_class", "left").select("row", "doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"), F.col("_class").alias("class"))
