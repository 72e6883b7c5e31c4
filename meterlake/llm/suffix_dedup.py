"""Exact removal of long repeated byte strings with suffix arrays.

**Bringing repeats together.** Each string of ``length`` bytes has an anchor: the
place in it whose 64-byte gram has the least hash (the leftmost of equal ones).
Equal strings have their anchors at the same place, so all repeats of a string
lie among the occurrences of one gram. Grams that occur once are dropped; for
the others the context of each occurrence (all strings of that anchor) is
gathered. Equal contexts are counted and sent once, so a passage with very many
copies is a few rows wherever its surroundings are equal.

**Finding them.** The contexts of a gram are read in blocks of 8 bytes from the
anchor, and the suffix array of all block sequences is built by grouping: suffixes
with one Lyndon prefix form a group; groups are taken in descending order,
pointers to the previous smaller suffix tell which suffixes a group's word
extends, and those move into new groups just above their old ones. Once all groups
are known the order inside them is emitted from the smallest suffix on, along the
same pointers, without renaming and recursion. Neighbours in the array that share
24 blocks or more form runs; the strings that begin up to 7 bytes before the
suffixes of a run are compared in full.

Every byte position is judged under one anchor, by all bytes of its string, and
the removed bytes are the union of the repeated strings.

Nulls and ties: a null text is empty, texts shorter than ``length`` lose nothing,
rows with equal texts are copies of each other even if their ids are equal or
null. An empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_dedup import flat_bytes
from .common import forget, spread, table, texts_of

GRAM, BLOCK = 64, 8

#: Bytes that are hashed at a time, and bytes of contexts in one suffix array.
SLICE, ARRAY_BYTES = 1_500_000, 400_000


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of numbers, the end counting as smaller than all, by Lyndon groups in descending order."""
    n = len(text)
    if n < 2:
        return list(range(n))
    order = np.argsort(np.asarray(text), kind="stable")
    values = np.asarray(text)[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    sizes = np.diff(np.append(begin, n))
    sa = order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    where = place.tolist()
    of = np.empty(n, np.int64)
    of[order] = np.repeat(begin, sizes)
    group = of.tolist()
    size = [0] * n
    for b, s in zip(begin.tolist(), sizes.tolist()):
        size[b] = s
    previous = [-1] * n
    top = n
    while top > 0:
        g = group[sa[top - 1]]
        members = sa[g:top]
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > g:
                p = previous[p]
            if p >= 0 and group[p] == g:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if len(times) == 1:
            (p,) = times
            moved = {(1, group[p]): [p]}
            keys = list(moved)
        else:
            moved = {}
            for p, k in times.items():
                moved.setdefault((k, group[p]), []).append(p)
            keys = sorted(moved, reverse=True)
        for key in keys:
            old, some = key[1], moved[key]
            k = len(some)
            if size[old] == k:
                continue
            end = old + size[old]
            new = end - k
            size[old] -= k
            size[new] = k
            for p in some:
                end -= 1
                at, other = where[p], sa[end]
                sa[end], sa[at] = p, other
                where[p], where[other] = end, at
                group[p] = new
        top = g
    out, free = [-1] * n, list(range(n))
    done = bytearray(n)

    def emit(s: int) -> None:
        while s >= 0 and not done[s]:
            done[s] = 1
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = previous[s]

    emit(n - 1)  # what the end precedes
    for i in range(n):
        if out[i] > 0:
            emit(out[i] - 1)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values, by minima from both ends of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).reshape(-1)
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 256).astype(np.uint64)


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, gram hash) of each run of strings with one anchor, in texts given one after the other."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < length:
        return none
    h = _byte_values()[data]
    step, power = 1, np.uint64(0x9E3779B97F4A7C15)
    while step < GRAM:
        h = h[:-step] * power + h[step:]
        power, step = power * power, step * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << 28) - 1)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    at = (least & low).astype(np.int64)
    starts = np.arange(len(at))
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(at)]
    inside = starts + length <= ends[of]
    starts, at, of = starts[inside], at[inside], of[inside]
    if not len(at):
        return none
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return of[first], at[first], starts[first], starts[last], h[at[first]]


def _small(batch: pa.RecordBatch, text_col: int):
    """(first row, texts, bytes, ends) of a batch, about ``SLICE`` bytes at a time."""
    texts = batch.column(text_col).cast(pa.large_string())
    if not len(texts):
        return
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.minimum(np.searchsorted(sizes, np.arange(SLICE, int(sizes[-1]) + SLICE, SLICE)) + 1, len(texts))).tolist()
    for first, end in zip([0, *cuts], [*cuts, len(texts)]):
        if end > first:
            held = texts.slice(first, end - first)
            yield first, held, *flat_bytes(held)


def grams(keyed: DataFrame, length: int) -> DataFrame:
    """(gram, h, times): the anchors' grams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held, data, ends in _small(batch, 1):
                of, _, _, _, gram = anchors(data, ends, length)
                order = np.lexsort((gram, of))
                of, gram = of[order], gram[order]
                new = np.concatenate([[True], (of[1:] != of[:-1]) | (gram[1:] != gram[:-1])]) if len(of) else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                times = np.diff(np.append(begin, len(of)))
                yield pa.RecordBatch.from_arrays([pa.array(gram[begin].view(np.int64)), batch.column(0).take(pa.array(of[begin] + first)), pa.array(times.astype(np.int64))], names=["gram", "h", "times"])

    return keyed.select("h", "text").mapInArrow(run, "gram long, h long, times long")


def contexts(met: DataFrame, length: int) -> DataFrame:
    """(gram, ctx, h, at, copies, lead, bytes) for the anchors of ``met`` (h, copies, grams, text) whose gram is wanted.

    ``bytes`` are all strings of the anchor, which lies ``lead`` bytes behind their begin; ``ctx`` is their digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held, data, ends in _small(batch, 3):
                of, at, low, high, gram = anchors(data, ends, length)
                wanted = batch.column(2).slice(first, len(held))
                flat = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(len(held)), pc.list_value_length(wanted).fill_null(0).to_numpy(zero_copy_only=False))
                mix = np.uint64(0x9E3779B97F4A7C15)
                keep = np.flatnonzero(np.isin(gram ^ (of.astype(np.uint64) * mix), flat ^ (owner.astype(np.uint64) * mix)))
                of, at, low, high, gram = of[keep], at[keep], low[keep], high[keep], gram[keep]
                raw = data.tobytes()
                bodies = [raw[a : b + length] for a, b in zip(low.tolist(), high.tolist())]
                lead = at - low
                ctx = [xxhash.xxh3_64_intdigest(x, seed=int(k)) for x, k in zip(bodies, lead)]
                begin = np.concatenate([[0], ends[:-1]])[of]
                rows = pa.array(of + first)
                columns = [pa.array(gram.view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64)), batch.column(0).take(rows), pa.array(low - begin), batch.column(1).take(rows), pa.array(lead), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "ctx", "h", "at", "copies", "lead", "bytes"])

    return met.select("h", "copies", "grams", "text").mapInArrow(run, "gram long, ctx long, h long, at long, copies long, lead long, bytes binary")


def repeats(distinct: DataFrame, length: int) -> DataFrame:
    """(gram, ctx, start, end): byte ranges of a context that repeated strings cover.

    ``distinct`` is (gram, ctx, n, lead, bytes), its rows dealt and sorted by gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last and size > ARRAY_BYTES:
                    yield _answer(held, length)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield _answer(held, length)

    return distinct.select("gram", "ctx", "n", "lead", "bytes").mapInArrow(run, "gram long, ctx long, start int, end int")


def _answer(rows: list[tuple], length: int) -> pa.RecordBatch:
    out: list[tuple[int, int, int, int]] = []
    alone: dict[int, int] = {}
    for gram, *_ in rows:
        alone[gram] = alone.get(gram, 0) + 1
    several = []
    for gram, ctx, n, lead, body in rows:
        if n > 1:
            out.append((gram, ctx, 0, len(body)))
        if alone[gram] > 1:
            several.append((gram, ctx, n, lead, body))
    out += _among(several, length)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["gram", "ctx", "start", "end"])


def _among(rows: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """Covered ranges of contexts of which no copies are known, by the suffix array of all."""
    if not any(r[2] == 1 for r in rows):
        return []
    values, owner, offset = [], [], []
    for k, (_, _, _, lead, body) in enumerate(rows):
        first = lead % BLOCK
        count = (len(body) - first) // BLOCK
        values.append(np.frombuffer(body, ">u8", count, first))
        owner.append(np.full(count + 1, k))
        offset.append(first + BLOCK * np.arange(count + 1))
    flat = np.concatenate(values).astype(np.uint64)
    names = np.unique(flat, return_inverse=True)[1] + len(rows)
    text, begin = np.zeros(len(flat) + len(rows), np.int64), 0
    for k, v in enumerate(values):
        end = begin + len(v)
        text[begin + k : end + k] = names[begin:end]
        text[end + k] = k  # its own end mark
        begin = end
    owner, offset = np.concatenate(owner), np.concatenate(offset)
    need = (length - BLOCK + 1) // BLOCK
    order = np.array(suffix_array(text.tolist()))
    padded = np.concatenate([text, np.full(need, -1)])
    same = np.ones(len(order) - 1, bool)
    for k in range(need):
        here = np.flatnonzero(same)
        same[here] = padded[order[here] + k] == padded[order[here + 1] + k]
    run = np.cumsum(np.concatenate([[True], ~same]))
    crowd = np.bincount(run)[run] > 1
    seen: dict[tuple[int, int, int], int] = {}
    places = []
    for r, s in zip(run[crowd].tolist(), order[crowd].tolist()):
        k, q = int(owner[s]), int(offset[s])
        body, weight = rows[k][4], rows[k][2]
        for back in range(BLOCK):
            a = q - back
            if a < 0 or a + length > len(body):
                continue
            key = (r, back, xxhash.xxh3_64_intdigest(body[a : a + length]))
            seen[key] = seen.get(key, 0) + weight
            if weight == 1:
                places.append((key, k, a))
    covered: dict[int, list[int]] = {}
    for key, k, a in places:
        if seen[key] > 1:
            covered.setdefault(k, []).append(a)
    out = []
    for k, starts in covered.items():
        gram, ctx = rows[k][:2]
        out += [(gram, ctx, a, b) for a, b in merged((a, a + length) for a in starts)]
    return out


def merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def covered_ranges(keyed: DataFrame, length: int) -> DataFrame:
    """(h, copies, ranges): copies of each text and the byte ranges that repeated strings cover in it."""
    spark = keyed.sparkSession
    texts = keyed.groupBy("h").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.first("n_bytes").alias("n_bytes"))
    texts = table(texts, "texts")
    sent = table(grams(keyed, length), "grams", codec="lz4")
    often = sent.groupBy("gram").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.max("times").alias("t")).where("x < y OR t > 1").select("gram")
    wanted = sent.select("h", "gram").join(often, "gram").groupBy("h").agg(F.collect_set("gram").alias("grams"))
    chosen = table(wanted.join(texts.select("h", "copies", "row"), "h").select("row", "copies", "grams"), "wanted")
    forget(spark, sent)
    found = table(contexts(keyed.join(chosen, "row"), length), "contexts")
    forget(spark, chosen)
    distinct = found.groupBy("gram", "ctx").agg(F.sum("copies").alias("n"), F.first("lead").alias("lead"), F.first("bytes").alias("bytes"))
    dealt = distinct.repartition(2 * spread(spark), "gram").sortWithinPartitions("gram", "ctx")
    answers = table(repeats(dealt, length), "repeats")
    ranges = found.select("gram", "ctx", "h", "at").join(answers, ["gram", "ctx"]).select("h", F.struct((F.col("at") + F.col("start")).alias("a"), (F.col("at") + F.col("end")).alias("b")).alias("range"))
    by_text = table(ranges.groupBy("h").agg(F.collect_set("range").alias("ranges")), "ranges")  # bounded by the text
    forget(spark, found)
    whole = F.when((F.col("copies") > 1) & (F.col("n_bytes") >= length), F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b"))))
    full = texts.join(by_text, "h", "left").select("h", F.coalesce(whole, "ranges").alias("ranges"))
    return full.where("ranges IS NOT NULL")


def remove_repeats(docs: DataFrame, length: int = 200, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every byte that a repeated string covers is removed.

    A string of ``length`` bytes is repeated if it starts at any other place,
    in the same or another document. ``kept`` are the remaining bytes, with
    ``digest`` their SHA-256 in hex (kept_sha256).
    """
    if length < GRAM + BLOCK:
        raise ValueError(f"strings shorter than {GRAM + BLOCK} bytes are not supported")
    base = texts_of(docs).select("doc_id", "text", F.xxhash64("text").alias("h"))
    keyed = base.select("doc_id", "text", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "h").alias("row"))
    ranges = covered_ranges(keyed, length)
    last = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, cut in zip(batch.column(1), batch.column(2).to_pylist()):
                body = text.as_buffer().to_pybytes()
                out = merged((r["a"], r["b"]) for r in cut or [])
                parts, at = [], 0
                for a, b in out:
                    parts.append(body[at:a])
                    at = b
                rest = b"".join([*parts, body[at:]])
                sizes.append(len(body)), removed.append(len(body) - len(rest)), spans.append(len(out))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", last])

    joined = keyed.select("doc_id", "text", "h").join(ranges, "h", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}")
