"""Passages that repeat across documents, by content-defined chunking.

A gear hash rolls over the bytes of a text: shifted left by one bit for each
byte, plus a table value. Sixteen bits are kept, so the hash depends on the last
sixteen bytes only, and a chunk ends where it falls below a bound. An insertion
therefore moves the chunk borders near it and no others. Long stretches without a
border are cut every ``LONGEST`` bytes.

Chunks of ``GRAM`` bytes or more are compared by digest over all documents; shorter ones
repeat by chance. Of equal chunks the first one, in order of document id and position,
stays, and the others are seeds. A passage may hold no such chunk, so stretches
of ``SPAN`` bytes without one give one more seed: of their grams
of ``GRAM`` bytes the one with the least hash. Any two copies of ``SPAN`` bytes or more
therefore share a seed of ``GRAM`` bytes or more, and a text that is shorter than that is
one chunk. A seed leads to its first copy only;
a passage is missed if all its seeds stand still earlier by chance.

Seeds that follow each other in both texts form a run. Each run is extended to both
sides, byte by byte, as far as the text around its first copy agrees: over at most
``CONTEXT`` bytes at first, and over eight times as many in each further round for the
few runs that agree to the end of that, until none does. A short gap between two runs along the
same copy is compared once, and runs of a row that lead to the same place share its bytes. Extended runs that touch are one, and those of at least
``least_words`` words are removed, so that chance repeats leave a text alone.

Texts are shuffled into a table in buckets of their rows, equal rows once; all steps up to the last join, which shuffles
the documents themselves, read it in place.
The rows that are shuffled besides are digests with positions, and the bytes beside the first
copies, once for each row and place. Texts are numbered in order, so that a place is one number; digests are counted before they
are shuffled, with their least place, all places are sent once, and the joins that mark and extend the later copies are such that Spark can split them at hot
keys.

Nulls and ties: a null text is empty and keeps nothing; rows equal in id and text
count as one document and get equal results; equal texts of different ids follow
their ids, null ids first. An empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, buckets_of, give_back, mix, passed_on, row_key, running_start, slices, table, texts_of, writing

#: Bytes of a chunk on average and at most.
MEAN, LONGEST = 40, 256

#: Words (white space and a word) that an extended run must hold to be removed.
LEAST_WORDS = 25

#: Bytes of a gram, and of the stretches of which each shares a chunk or a gram with its copies; 51 words have more.
GRAM, SPAN = 32, 95

#: Bytes to each side of a run that are compared in the first round.
CONTEXT = 64


def gear_table() -> np.ndarray:
    """Sixteen random bits for each byte value, from a fixed seed."""
    return np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 16, 256).astype(np.uint16)


def gear_cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a chunk ends behind each byte by its hash, which the sixteen bytes up to there decide."""
    h = gear_table()[data]
    start = np.concatenate([[0], ends[:-1]])
    for step in (1, 2, 4, 8):  # h over 2, 4, 8, 16 bytes; bytes of the text before are shifted out or ignored below
        more = h.copy()
        more[step:] += (h[:-step] << np.uint16(step)).astype(np.uint16)
        h = more
    cut = h < np.uint16((1 << 16) // MEAN)
    # the first sixteen bytes of a text would see the text before; they get no border
    fresh = np.zeros(len(data) + 1, np.int32)
    np.add.at(fresh, np.minimum(start, len(data)), 1)
    np.add.at(fresh, np.minimum(np.minimum(start + 15, ends), len(data)), -1)
    cut &= np.cumsum(fresh[:-1]) <= 0
    return cut


def borders(data: np.ndarray, ends: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of texts given one after the other, and the text of each chunk. Empty texts have none. ``cut`` is what ``gear_cuts`` gives."""
    cut = gear_cuts(data, ends) if cut is None else cut.copy()
    start = np.concatenate([[0], ends[:-1]])
    full = ends[ends > start] - 1
    cut[full] = True
    places = np.flatnonzero(cut) + 1
    before = np.concatenate([[0], places[:-1]]) if len(places) else places
    extra = (places - before - 1) // LONGEST
    if extra.any():
        of = np.repeat(np.arange(len(places)), extra)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        places = np.sort(np.concatenate([places, before[of] + nth * LONGEST]))
    return places, np.searchsorted(ends, places - 1, side="right")


def grams(data: np.ndarray, ends: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """First bytes of the grams that are seeds: the least of each stretch of ``SPAN`` bytes without a chunk of ``GRAM`` bytes. ``cut`` is what ``gear_cuts`` gives."""
    size, wide = len(data), SPAN - GRAM + 1  # grams of a stretch; a power of two
    if size < SPAN:
        return np.zeros(0, np.int64)
    h = np.random.Generator(np.random.PCG64(20240608)).integers(0, 1 << 32, 256, np.uint32)[data]
    step = 1
    while step < GRAM:  # h over 2, 4, ... bytes from each place on
        h = h[:-step] * np.uint32(pow(0x9E3779B1, step, 1 << 32)) + h[step:]
        step *= 2
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    h |= np.uint32(1)  # 0 stands for stretches that give no seed
    least, step = h, 1
    while step < wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    cuts = np.flatnonzero(cut) + 1
    long = np.flatnonzero(np.diff(cuts) >= GRAM)
    began = np.full(size + 1, -1)
    began[cuts[long + 1]] = cuts[long]
    began = np.maximum.accumulate(began)[SPAN:]  # of the last long chunk that ends in or before a stretch
    first = np.arange(len(least))
    fits = first + SPAN <= np.repeat(ends, np.diff(ends, prepend=0))[: len(least)]
    least = np.where(fits & (began < first + 16), least, np.uint32(0))
    most, step = np.concatenate([np.zeros(wide - 1, np.uint32), least, np.zeros(wide - 1, np.uint32)]), 1
    while step < wide:
        most = np.maximum(most[:-step], most[step:])
        step *= 2
    chosen = most == h
    # inside a stretch of one byte all grams are equal: its first and last will do
    same = np.concatenate([[False], h[1:] == h[:-1], [False]])
    return np.flatnonzero(chosen & ~(same[:-1] & same[1:]))


def long_chunks(places: np.ndarray, of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of the chunks that are compared: long ones, and texts below ``SPAN`` bytes whole."""
    begin = np.concatenate([[0], places[:-1]]) if len(places) else places
    sizes = np.diff(ends, prepend=0)
    keep = (places - begin >= GRAM) & (sizes[of] >= SPAN)
    short = np.flatnonzero((sizes > 0) & (sizes < SPAN))
    begin, stop, of = np.concatenate([begin[keep], (ends - sizes)[short]]), np.concatenate([places[keep], ends[short]]), np.concatenate([of[keep], short])
    order = np.argsort(begin, kind="stable")
    return begin[order], stop[order], of[order]


def gram_digests(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of the ``GRAM`` bytes from each place on."""
    digest = np.full(len(first), GRAM, np.uint64)
    if len(first):
        for part in np.lib.stride_tricks.sliding_window_view(data, GRAM)[first].view(np.uint64).T:
            digest = mix(digest * np.uint64(0x9E3779B97F4A7C15) + part)
    return digest


def places_of(texts: DataFrame) -> DataFrame:
    """(row, place): where a text begins when all stand one behind the other in the order of ids and rows, each on 2^32 places."""
    rows = texts.select("row", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.lit(1).alias("one"))
    nth = F.col("nth")
    place = F.when(nth < 2**31, F.shiftleft(nth, 32)).otherwise(F.raise_error(F.lit("more than 2^31 texts")).cast("long"))
    return running_start(rows, ["id", "row"], "one", "nth", 64).select("row", place.alias("place"))


def seeds(keyed: DataFrame) -> DataFrame:
    """(row, place, size, digest) of the long chunks and of the grams; ``place`` is that of the first byte, ``size`` is below zero for grams."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for first, held in slices(batch, most=500_000):
                data, ends = flat_bytes(held)
                cut = gear_cuts(data, ends)
                begin, places, of = long_chunks(*borders(data, ends, cut), ends)
                more = grams(data, ends, cut)
                raw = data.tobytes()
                digests = np.concatenate([
                    np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), places.tolist())), np.uint64, len(places)),
                    gram_digests(data, more),
                ])
                sizes = np.concatenate([places - begin, np.full(len(more), -GRAM)]).astype(np.int32)
                of = np.concatenate([of, np.searchsorted(ends, more, side="right")]).astype(np.int64)
                at = np.concatenate([begin, more]).astype(np.int64) - np.concatenate([[0], ends[:-1]])[of]
                row, place = (batch.column(k).to_numpy(zero_copy_only=False)[first:][of] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(place + at), pa.array(sizes), pa.array(digests.view(np.int64))], names=["row", "place", "size", "digest"])
            pa.default_memory_pool().release_unused()

    return keyed.select("row", "place", "text").mapInArrow(run, "row long, place long, size int, digest long")


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a slice of texts one after the other, and where each ends."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    buffers = texts.buffers()
    if not len(texts) or buffers[2] is None or not ends[-1]:
        return np.zeros(0, np.uint8), ends
    begin = int(np.frombuffer(buffers[1], np.int64)[texts.offset])
    return np.frombuffer(buffers[2], np.uint8)[begin : begin + int(ends[-1])], ends


def _merged(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First members of the runs that touching spans of one group form, and the ends of the runs; sorted by group and start."""
    base = group.astype(np.int64) << 40
    far = np.maximum.accumulate(base + stop)
    new = np.concatenate([[True], (base + start)[1:] > far[:-1]])[: len(group)]
    first = np.flatnonzero(new)
    return first, (far - base)[np.concatenate([first[1:], [len(group)]]) - 1] if len(first) else first


RUNS = "array<struct<lead:long,start:long,stop:long,open:int>>"
ASKS = "array<struct<place:long,length:long>>"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut so that equal values stay together."""
    rest = None
    for batch in batches:
        if len(batch):
            batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            rows = batch.column(0).to_numpy()
            cut = int(np.searchsorted(rows, rows[-1]))
            if cut:
                yield batch.slice(0, cut)
            rest = batch.slice(cut)
    if rest is not None:
        yield rest


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Lists of the values of ``n`` rows; ``of`` is the row of each, ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)


def _structs(**fields: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields))


def asked(of: np.ndarray, lead: np.ndarray, start: np.ndarray, stop: np.ndarray, open: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(side, length, place, whole): the bytes of first copies that runs, sorted by row, lead and start, are compared with next.

    Side 2k is the left one of run k, 2k + 1 its right one. At most ``size`` bytes are asked for, none beyond the next run with the
    same lead, and those before a place if ``length`` is below zero. A gap of at most twice ``size`` between open sides is asked for once and ``whole``.
    """
    n = len(of)
    far = np.full(n + 1, 1 << 62)  # to the run before
    same = np.flatnonzero((of[1:] == of[:-1]) & (lead[1:] == lead[:-1])) + 1
    far[same] = start[same] - stop[same - 1]
    left, right = (open & 1 != 0) & (start > 0), open & 2 != 0
    whole = right & np.concatenate([left[1:], [False]])[:n] & (far[1:] <= 2 * size)
    left[1:] &= ~whole[:-1]
    length = np.zeros(2 * n, np.int64)
    length[0::2] = np.where(left, -np.minimum(size, far[:-1]), 0)
    length[1::2] = np.where(whole, far[1:], np.where(right, np.minimum(size, far[1:]), 0))
    side = np.flatnonzero(length)
    place = np.stack([lead + start, lead + stop], axis=1).ravel()[side]
    return side, length[side], place, whole


def _once(of: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each set of equal asks of a row, and of each ask the number of its set: runs of a text that repeats itself lead to the same places."""
    order = np.lexsort((length, place, of))
    new = np.concatenate([[True], np.any([np.diff(x[order]) != 0 for x in (of, place, length)], axis=0)])[: len(of)]
    nth = np.empty(len(of), np.int64)
    nth[order] = np.cumsum(new) - 1
    return order[new], nth


def _open_runs(of: np.ndarray, n: int, lead: np.ndarray, start: np.ndarray, stop: np.ndarray, open: np.ndarray, size: int) -> list[pa.Array]:
    """Runs that may go on and what they ask for, each once, as lists for ``n`` rows."""
    side, length, place, _ = asked(of, lead, start, stop, open, size)
    once, _ = _once(of[side >> 1], place, length)
    return [_lists(of, n, _structs(lead=lead, start=start, stop=stop, open=open.astype(np.int32))), _lists(of[side[once] >> 1], n, _structs(place=place[once], length=length[once]))]


def runs_of(later: DataFrame, buckets: int) -> DataFrame:
    """(row, ats, runs, asks): the repeated chunks of a row, and the runs of seeds that follow each other in both texts.

    ``lead`` is the place of the first copy less that in the text; it tells first copies and shifts apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            row, lead, at, size = (c.to_numpy() for c in batch.columns)
            keys, of = np.unique(row, return_inverse=True)
            order = np.lexsort((at, lead, of))
            of, lead, at, size = of[order], lead[order], at[order], size[order].astype(np.int64)
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (lead[1:] != lead[:-1])])
            first, stop = _merged(np.cumsum(new), at, at + np.abs(size))
            chunk = size > 0
            held = _open_runs(of[first], len(keys), lead[first], at[first], stop, np.full(len(first), 3), CONTEXT)
            yield pa.RecordBatch.from_arrays([pa.array(keys), _lists(of[chunk], len(keys), pa.array(at[chunk])), *held], names=["row", "ats", "runs", "asks"])
            pa.default_memory_pool().release_unused()

    return later.repartition(buckets, "row").sortWithinPartitions("row").mapInArrow(run, f"row long, ats array<long>, runs {RUNS}, asks {ASKS}")


def contexts(texts: DataFrame, places: DataFrame, sides: DataFrame) -> DataFrame:
    """(place, length, near): the bytes from a place of a text on, or before it if ``length`` is below zero; each once."""
    wanted = sides.select("place", "length").distinct().groupBy(F.shiftright("place", 32).alias("nth")).agg(F.collect_list(F.struct("place", "length")).alias("wanted"))  # bounded by one text
    wanted = wanted.join(places.select(F.shiftright("place", 32).alias("nth"), "row"), "nth").select("row", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in slices(batch, most=1_000_000):
                data, ends = flat_bytes(held)
                raw, starts = data.tobytes(), np.concatenate([[0], ends[:-1]])
                of, asks = _flat_lists(batch.column(1).slice(first, len(held)))
                place, length = (x.to_numpy() for x in asks.flatten())
                pos = starts[of] + (place & 0xFFFFFFFF)
                a, b = np.maximum(np.minimum(pos, pos + length), starts[of]), np.minimum(np.maximum(pos, pos + length), ends[of])
                near = pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(length), near], names=["place", "length", "near"])
            pa.default_memory_pool().release_unused()

    return texts.select("row", "text").join(wanted, "row").select("text", "wanted").mapInArrow(run, "place long, length long, near binary")


def compared(data: np.ndarray, a: np.ndarray, near: np.ndarray, b: np.ndarray, n: np.ndarray, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that strings share from their start, and to their end: ``n`` bytes at ``a`` of ``data`` and at ``b`` of ``near``.

    Long strings are compared one by one, short ones about ``most`` bytes at a time.
    """
    ahead, behind = n.copy(), n.copy()
    long = np.flatnonzero(n > 4 * CONTEXT)
    if len(long):
        own, other = data.tobytes(), near.tobytes()
        for k, p, q, m in zip(long.tolist(), a[long].tolist(), b[long].tolist(), n[long].tolist()):
            if own[p : p + m] != other[q : q + m]:
                differ = data[p : p + m] != near[q : q + m]
                ahead[k], behind[k] = differ.argmax(), differ[::-1].argmax()
    short = np.flatnonzero(n <= 4 * CONTEXT)
    for ks in np.split(short, np.searchsorted(upto := np.cumsum(n[short]), np.arange(most, int(upto[-1]), most))) if len(short) else []:
        ends = np.cumsum(n[ks])
        begin, byte = ends - n[ks], np.arange(int(n[ks].sum()))
        differ = np.flatnonzero(data[byte + np.repeat(a[ks] - begin, n[ks])] != near[byte + np.repeat(b[ks] - begin, n[ks])])
        x, y = np.searchsorted(differ, begin), np.searchsorted(differ, ends)
        some = np.flatnonzero(y > x)
        ahead[ks[some]] = differ[x[some]] - begin[some]
        behind[ks[some]] = ends[some] - 1 - differ[y[some] - 1]
    return ahead, behind


def _longer(data: np.ndarray, ends: np.ndarray, of: np.ndarray, runs: list[np.ndarray], near: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(of, lead, start, stop, open) of runs extended by what they asked for; those that touch are one. ``near`` is cut at ``bounds``."""
    lead, start, stop, open = runs
    side, length, place, whole = asked(of, lead, start, stop, open, size)
    k, right = side >> 1, side & 1 == 1
    _, nth = _once(of[k], place, length)
    head, tail = bounds[:-1][nth], bounds[1:][nth]
    begin = np.concatenate([[0], ends[:-1]])[of[k]]
    n = np.minimum(tail - head, np.where(right, ends[of[k]] - begin - stop[k], start[k]))
    a = begin + np.where(right, stop[k], start[k] - n)
    ahead, behind = compared(data, a, near, np.where(right, head, tail - n), n)
    more = np.zeros((len(of) + 1, 2), np.int64)  # to the left and right of each run
    more[k[right], 1], more[k[~right], 0] = ahead[right], behind[~right]
    gap = right & whole[k]
    more[k[gap] + 1, 0] = behind[gap]
    on = np.zeros((len(of), 2), bool)
    on[k[right], 1], on[k[~right], 0] = (ahead == size)[right] & ~gap[right], (behind == size)[~right]
    start, stop = start - more[:-1, 0], stop + more[:-1, 1]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (lead[1:] != lead[:-1]) | (start[1:] > stop[:-1])])[: len(of)]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(of)]])[: len(first)] - 1
    return of[first], lead[first], start[first], stop[last], on[first, 0] + 2 * on[last, 1]


def extend(texts: DataFrame, places: DataFrame, buckets: int, runs: DataFrame, size: int) -> DataFrame:
    """(row, more, runs, asks): runs (row, runs, asks) extended by at most ``size`` bytes at their open sides, and those that may go on.

    ``open`` is 1 if the left side may go on, 2 if the right one may, 3 for both.
    """
    sides = runs.select("row", F.posexplode("asks").alias("k", "ask")).select("row", "k", "ask.place", "ask.length")
    near = sides.join(contexts(texts, places, sides), ["place", "length"])
    held = near.repartition(buckets, "row").groupBy("row").agg(F.collect_list(F.struct("k", "near")).alias("sides"))  # bounded by the runs of the row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, text in slices(batch, most=1_000_000):
                n = len(text)
                data, ends = flat_bytes(text)
                of, fields = _flat_lists(batch.column(2).slice(first, n))
                owner, got = _flat_lists(batch.column(3).slice(first, n))
                nth, near = got.flatten()
                near = near.take(pa.array(np.lexsort((nth.to_numpy(), owner)))).cast(pa.large_binary())
                bounds = np.concatenate([[0], np.cumsum(pc.binary_length(near).to_numpy())]).astype(np.int64)
                raw = near.buffers()[2]
                flat = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
                of, lead, start, stop, open = _longer(data, ends, of, [x.to_numpy() for x in fields.flatten()], flat, bounds, size)
                on = open != 0
                rest = _open_runs(of[on], n, lead[on], start[on], stop[on], open[on], 8 * size)
                rows = batch.column(0).take(pa.array(np.arange(first, first + n)))
                yield pa.RecordBatch.from_arrays([rows, _lists(of, n, _structs(start=start, stop=stop)), *rest], names=["row", "more", "runs", "asks"])
            pa.default_memory_pool().release_unused()

    joined = texts.select("row", "text").join(held, "row").join(runs.select("row", "runs"), "row").select("row", "text", "runs", "sides")
    return joined.mapInArrow(run, f"row long, more array<struct<start:long,stop:long>>, runs {RUNS}, asks {ASKS}")


def repeated(keyed: DataFrame) -> DataFrame:
    """(row, ats, repeats): the chunks of a row of which an earlier copy exists, and the extended runs."""
    buckets = buckets_of(keyed)
    texts = bucketed(keyed.dropDuplicates(["row"]), "texts", "row", buckets)
    places = bucketed(places_of(texts), "places", "row", buckets)
    found = seeds(texts.join(places, "row"))
    # digests are counted before the shuffle, with their least place; most occur once, and no others are joined with their copies
    firsts = found.groupBy("digest").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").select("digest", "first")
    at = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    later = found.join(firsts.hint("shuffle_hash"), "digest").where("place <> first").select("row", (F.col("first") - at).alias("lead"), at.alias("at"), "size")
    with writing(keyed.sparkSession):
        left = table(runs_of(later, buckets), "runs")
    # a run of seeds is repeated whether or not anything is asked for beside it
    none = F.array().cast("array<struct<start:long,stop:long>>")
    repeats = F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    spans, size, repeats = left.select("row", "ats", repeats.alias("repeats")), CONTEXT, F.col("repeats")
    left = left.where("size(asks) > 0")
    while not left.isEmpty():
        with writing(keyed.sparkSession):
            more = table(extend(texts, places, buckets, left, size), "extended")
        spans = spans.join(more.select("row", "more"), "row", "left").select("row", "ats", F.concat(repeats, F.coalesce("more", none)).alias("repeats"))
        left, size = more.where("size(asks) > 0"), 8 * size
    return spans


def cut_texts(columns: list[str], schema: str, joined: DataFrame, least_words: int) -> DataFrame:
    """Takes the runs out of the texts of ``joined`` (its columns, ats, repeats); adds n_chunks, n_repeated, n_removed and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        text_at, ats_at = columns.index("text"), len(columns)
        for batch in batches:
            for first, held in slices(batch, most=1_000_000):
                data, ends = flat_bytes(held)
                places, of = borders(data, ends)
                begins, long, owner = long_chunks(places, of, ends)
                texts, n_chunks, n_repeated, n_removed, spans = [], [], [], [], []
                counts, starts = np.bincount(of, minlength=len(held)), np.concatenate([[0], ends[:-1]])
                seen, at = _flat_lists(batch.column(ats_at).slice(first, len(held)))
                at = at.to_numpy(zero_copy_only=False).astype(np.int64)
                chunk_stop = long[np.searchsorted(begins, at + starts[seen])] - starts[seen] if len(at) else at
                wider, spans_held = _flat_lists(batch.column(ats_at + 1).slice(first, len(held)))
                start, stop = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans_held.flatten())
                group, start, stop = np.concatenate([seen, wider]), np.concatenate([at, start]), np.concatenate([chunk_stop, stop])
                order = np.lexsort((start, group))
                group, start = group[order], start[order]
                run_first, run_stop = _merged(group, start, stop[order])
                pieces = list(zip(start[run_first].tolist(), run_stop.tolist()))
                bounds = np.searchsorted(group[run_first], np.arange(len(held) + 1)).tolist()
                n_seen = np.bincount(seen, minlength=len(held)).tolist()
                raw = data.tobytes()
                for k in range(len(held)):
                    body = raw[int(starts[k]) : int(ends[k])]
                    out = _long_runs(body, pieces[bounds[k] : bounds[k + 1]], least_words)
                    kept, last = [], 0
                    for a, b in out:
                        kept.append(body[last:a])
                        last = b
                    kept.append(body[last:])
                    texts.append(b"".join(kept).decode() if out else body.decode())
                    n_chunks.append(int(counts[k])), n_repeated.append(n_seen[k]), n_removed.append(sum(b - a for a, b in out)), spans.append([{"start": a, "end": b} for a, b in out])
                own = passed_on(batch, first, len(held))[: len(columns)]
                own[text_at] = pa.array(texts, pa.string())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_chunks, pa.int64()), pa.array(n_repeated, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind)], names=[*columns, *names])

    names = ["n_chunks", "n_repeated", "n_removed", "spans"]
    return joined.select(*columns, "ats", "repeats").mapInArrow(run, f"{schema}, n_chunks long, n_repeated long, n_removed long, spans array<struct<start:long,end:long>>")


def _flat_lists(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each value of the lists, and the values; a null is an empty list."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), counts), lists.flatten()


def _long_runs(body: bytes, runs: list[tuple[int, int]], least_words: int) -> list[tuple[int, int]]:
    """Those with enough words, narrowed to whole characters, of the repeated chunks and extended runs of a text, joined where they touch."""
    n, kept = len(body), []
    for a, b in runs:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < n and body[b] & 0xC0 == 0x80:
            b -= 1
        if b > a and (b - a == n or len(body[a:b].split()) >= least_words):
            kept.append((a, b))
    return kept


def dedup_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text, n_chunks, n_repeated, n_removed, spans): texts without passages that stand earlier.

    A text that lies in repeated passages from end to end is removed whole, however short. ``n_chunks`` counts all chunks of a text,
    ``n_repeated`` the long ones of which an earlier copy exists.
    ``spans`` are byte ranges of the UTF-8 text as it was.
    """
    keyed = texts_of(docs).withColumn("row", row_key())
    joined = keyed.join(repeated(keyed), "row", "left").select("doc_id", "text", "ats", "repeats")
    return cut_texts(["doc_id", "text"], "doc_id long, text string", joined, least_words)
