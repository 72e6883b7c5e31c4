import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from meterlake.llm import chunk_dedup, common, fingerprints, graph, jaccard, licenses, quality, suffix_dedup

from .conftest import words


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


def test_components(spark):
    g = random.Random(1)
    edges = [(g.randrange(300), g.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(5000, 5100)] + [(9, 9)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {v: find(v) for v in root}


def brute_jaccard(rows, n, threshold):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return [(i, len(s), min((x for x in least[find(k)] if x is not None), default=None)) for k, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("n, threshold", [(4, "0.85"), (5, "0.8"), (2, "0.6")])
def test_jaccard_join(spark, odd_docs, odd_rows, n, threshold):
    g = random.Random(2)
    base = [words(g, g.randint(1, 50), "abc") for _ in range(25)]
    extra = []
    for k in range(250):
        w = g.choice(base).split()
        for _ in range(g.randint(0, 3)):
            w[g.randrange(len(w))] = g.choice("xyZ")
        extra.append((100 + k, " ".join(w)))
    rows = odd_rows + extra
    docs = odd_docs.select("doc_id", "text", "row", "set", "a").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    found = [tuple(r) for r in jaccard.jaccard_components(docs, n, threshold).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(found, key=key) == sorted(brute_jaccard(rows, n, Fraction(threshold)), key=key)


def test_pairs_alone_in_a_table(spark):
    """A pair has nothing but itself to be frequent with; many pairs, none sharing a word with another one, behave as each alone."""
    g = random.Random(6)
    for n, threshold in ((4, "0.85"), (5, "0.8")):
        rows = [(0, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (1, "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13")]
        for k in range(2, 500, 2):
            body = [f"p{k}.{j}" for j in range(g.randint(1, 60))]
            other = list(body)
            for _ in range(g.randint(0, 2)):
                place = g.choice([0, len(other), g.randint(0, len(other))])
                other[place : place + g.randint(0, 1)] = [f"q{k}"] * g.randint(0, 1)
            rows += [(k, " ".join(body)), (k + 1, " ".join(other))]
        expected = brute_jaccard(rows, n, Fraction(threshold))
        found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, threshold)
        assert sorted(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()) == sorted(expected)
        linked = [k for k in range(0, 500, 2) if expected[k + 1][2] == k]
        assert len(linked) > 50
        for k in [0, *g.sample(linked, 2)]:
            alone = jaccard.jaccard_components(spark.createDataFrame(rows[k : k + 2], "doc_id long, text string"), n, threshold)
            assert {r["component_id"] for r in alone.collect()} == {expected[k][2], expected[k + 1][2]}


def test_large_classes_are_compared_in_blocks(spark, monkeypatch):
    g = random.Random(3)
    base = words(g, 60).split()
    rows = []
    for k in range(40):
        w = list(base)
        w[g.randrange(len(w))] = f"new{k}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    found = [tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, "0.85").select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(found) == sorted(brute_jaccard(rows, 4, Fraction("0.85")))


def test_fragments_outnumber_differences():
    for threshold in (Fraction("0.85"), Fraction("0.8"), Fraction("0.6")):
        steps = jaccard.Steps(threshold)
        for small in (1, 2, 3, 5, 9, 17, 50, 199, 1000):
            for large in range(small, math.floor(small / threshold) + 1):
                a, b = steps.of(np.array([small, large]))
                assert b - a in (0, 1)
                differ = jaccard.most_differences(small + large, threshold)
                for step in {a, b - 1 if b > a else a}:
                    # similar sets share more fragments than they leave out
                    assert steps.fragments[step] - differ > steps.spares[step]


def brute_repeats(rows, length):
    bodies, seen = [(t or "").encode() for _, t in rows], Counter()
    for b in bodies:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, bodies):
        mark = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mark[k] += 1
                mark[k + length] -= 1
        gone = np.cumsum(mark)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_suffix_array():
    g = random.Random(5)
    for _ in range(400):
        text = [g.randint(0, g.choice([1, 2, 8])) for _ in range(g.randint(0, 40))]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_strings_are_removed(spark, odd_docs, odd_rows):
    g = random.Random(6)
    passages = [words(g, g.randint(20, 120), "abcé") for _ in range(8)]
    extra = []
    for k in range(60):
        parts = []
        for _ in range(g.randint(0, 3)):
            p = g.choice(passages)
            a = g.randint(0, len(p))
            parts += [p[a : g.randint(a, len(p))], words(g, g.randint(0, 20))]
        extra.append((100 + k, " ".join(parts)))
    extra += [(900, "a" * 700), (901, "ab" * 300), (902, "z" * 199), (903, "z" * 200), (904, "q" * 200), (905, "q" * 200)]
    docs = odd_docs.select("doc_id", "text", "h", "row").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    found = [tuple(r) for r in suffix_dedup.remove_repeats(docs, digest=True).collect()]
    assert sorted(found, key=key) == sorted(brute_repeats(odd_rows + extra, 200), key=key)


def test_passages_are_removed_once_and_clean_texts_stay(odd_docs, odd_rows):
    found = chunk_dedup.dedup_passages(odd_docs).collect()
    texts = {r["doc_id"]: r for r in found if [x[0] for x in odd_rows].count(r["doc_id"]) == 1}
    before = dict(odd_rows)
    assert len(found) == len(odd_rows)
    assert texts[10]["text"] == before[10] and texts[10]["n_removed"] == 0
    assert 0 < texts[11]["n_removed"] < len(before[11]) and texts[11]["n_removed"] > 0.5 * (len(before[10]) * 60 / 140)
    assert texts[9]["text"] == "" and texts[7]["text"] == before[7]  # an exact copy goes whole
    assert texts[13]["n_removed"] == 0 and texts[2]["text"] == ""
    for r in found:
        if r["spans"] and r["doc_id"] in before:
            body = before[r["doc_id"]].encode()
            assert len(body) - sum(s["end"] - s["start"] for s in r["spans"]) == len(r["text"].encode())


@pytest.mark.parametrize("kind, longest", [("abcdefgh", 5), ("abcdefgh", 1), ("abé漢", 3)])
def test_passages_of_51_words_go_wherever_they_stand(spark, kind, longest):
    g = random.Random(8)

    def some(n, kind=kind):
        return " ".join("".join(g.choice(kind) for _ in range(g.randint(1, longest))) for _ in range(n))

    rows, planted = [], {}
    for k in range(300):
        passage, sides = some(51), [some(g.randint(0, 60), "0123456789") for _ in range(4)]
        rows += [(k, f"{sides[0]}<{passage}>{sides[1]}"), (1000 + k, f"{sides[2]}[{passage}]{sides[3]}")]
        planted[1000 + k] = (f"{sides[2]}[", passage)
    found = {r["doc_id"]: r for r in chunk_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, (before, passage) in planted.items():
        # a short chunk that repeats by chance and touches the passage goes with it
        (span,) = found[i]["spans"]
        a, b = len(before.encode()), len((before + passage).encode())
        assert a - 40 <= span["start"] <= a and b <= span["end"] <= b + 40
    assert sum(found[i]["n_removed"] == len(passage.encode()) for i, (_, passage) in planted.items()) > 0.95 * len(planted)
    assert all(found[k]["n_removed"] == 0 and found[k]["text"] == text for k, text in rows if k < 1000)


def test_runs_are_extended_past_chunks_with_other_first_copies(spark):
    g = random.Random(9)
    middle, head = words(g, 900), words(g, 12)
    rows = [(1, "X" + middle + "Y"), (2, "<" + head + middle + ">"), (3, "[" + head + middle + "]")]
    found = {r["doc_id"]: r["text"] for r in chunk_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1], found[2], found[3]) == (rows[0][1], "<" + head + ">", "[]")


def test_chunk_borders_resist_insertions():
    g = random.Random(7)
    text = words(g, 2000).encode()
    moved = b"inserted " + text
    ends = [chunk_dedup.borders(np.frombuffer(t, np.uint8), np.array([len(t)]))[0] for t in (text, moved)]
    assert len(set(ends[0]) & {e - 9 for e in ends[1]}) > 0.97 * len(ends[0])
    assert np.diff(chunk_dedup.borders(np.zeros(5000, np.uint8), np.array([5000]))[0], prepend=0).max() <= chunk_dedup.LONGEST


def brute_likeness(a, b):
    def level(t):
        return max(2, math.ceil(math.log2(max(len(t), 1) / 16)))

    for x, y in ((0, 0), (1, 0), (0, 1)):
        if level(a) + x == level(b) + y:
            p, q = (set(re.findall(r"[^\n]{1,%d}" % (1 << n), t)) for t, n in ((a, level(a) + x), (b, level(b) + y)))
            return len(p & q) / len(p | q) if p | q else 1.0
    return 0.0


def test_fingerprints(odd_docs, odd_rows):
    single = [r for r in odd_rows if [x[0] for x in odd_rows].count(r[0]) == 1]
    docs = odd_docs.where(odd_docs["doc_id"].isin([i for i, _ in single]))
    found = sorted(fingerprints.fingerprint(docs).collect())
    texts = [t or "" for _, t in sorted(single)]
    assert [r["doc_id"] for r in found] == sorted(i for i, _ in single)
    for k, r in enumerate(found):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(brute_likeness(text, edited)) and r["near_next"] == pytest.approx(brute_likeness(text, after))
    by_text = defaultdict(set)
    for r in fingerprints.fingerprint(odd_docs).collect():
        by_text[r["n_chars"]].add(r["fingerprint"])
    assert len(by_text[0]) == 1


def test_differences_of_many_lines_and_distant_texts(spark):
    g = random.Random(10)
    lines = [f"line {k} {words(g, 2)}" for k in range(2600)]
    texts = ["\n".join(lines[:1800]), "\n".join(lines[1300:]), "\n".join(lines[2590:])]
    found = sorted(fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r["near_next"] for r in found] == pytest.approx([500 / 2600, 10 / 1300, 0.0])
    assert all(r["n_edited_differences"] >= 0 for r in found)


def test_licenses_of_odd_rows_and_frames(spark, odd_docs, no_docs):
    rows = [(100, "Some words.\nThis work is licensed under the GNU General Public License, version 3."), (101, "Released under the MIT License.\n" + "plain words " * 50), (102, "I renewed my fishing license yesterday."), (103, "All rights reserved."), (104, "Licensed under CC BY-NC 4.0.\nAll rights reserved.")]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(odd_docs.select("doc_id", "text", "row").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)).collect()}
    assert {k: found[k]["family"] for k in (100, 101, 102, 103, 16, 7, 3)} == {100: "gpl", 101: "mit", 102: "none", 103: "proprietary", 16: "apache", 7: "none", 3: "none"}
    assert set(found[104]["families"]) == {"cc-by-nc", "proprietary"}


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    weights, thresholds = quality.train(docs, labels.where("pmod(xxhash64(doc_id, 7), 2) = 0"))
    assert list(thresholds) == sorted(thresholds)
    held = docs.join(labels.where("pmod(xxhash64(doc_id, 7), 2) = 1"), "doc_id").select("doc_id", "text", "quality", "toxic")
    rows = quality.score(held, weights, thresholds, "doc_id long, text string, quality int, toxic int", held.columns).collect()
    kept = {k: np.mean([r["p_good"] >= 0.5 for r in rows if f(r)]) for k, f in {"toxic": lambda r: r["toxic"] == 1, "junk": lambda r: r["quality"] == 0, "clean": lambda r: r["quality"] == 1 and r["toxic"] == 0}.items()}
    assert kept["toxic"] < 0.1 and kept["junk"] < 0.12 and kept["clean"] > 0.985, kept


def test_quality_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, None), (15, 0, 0), (None, 1, 1), (2, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd_docs, labels).count() == len(odd_rows)
    assert quality.classify(no_docs, labels).count() == 0
    assert quality.classify(odd_docs, labels.where("false")).where("keep").count() == len(odd_rows)


def test_quality_counts_a_labelled_id_once(spark, monkeypatch):
    """However many rows an id has, and however often it is labelled alike, the driver gets one of each grade."""
    rows = [(7, f"text number {k % 3}") for k in range(3000)] + [(8, "good words here"), (9, "bad words there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 0)] * 5 + [(7, 0, 0), (8, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = []
    monkeypatch.setattr(quality, "fit", lambda features, grades: got.append((len(features), sorted(grades.tolist()))))
    quality.train(docs, labels)
    quality.train(docs.repartition(7), labels)
    assert got == [(4, [0, 1, 2, 2])] * 2


def test_empty_tables(no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0
    assert suffix_dedup.remove_repeats(no_docs, digest=True).count() == 0
    assert chunk_dedup.dedup_passages(no_docs).count() == 0
    assert fingerprints.fingerprint(no_docs).count() == 0


class Mapped:
    """Stands for a table; gives the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


def test_stages_give_back_what_other_operators_keep_in_a_worker():
    for stage in (jaccard.describe(Mapped(), 4), chunk_dedup.seeds(Mapped())):
        held = common.remembered("other", dict)
        assert common.remembered("other", dict) is held
        assert not list(stage(iter([])))
        assert not common._remembered
    common.remembered("one", dict)
    common.remembered("two", dict)
    assert list(common._remembered) == ["two"]
    common.give_back()


def test_digests_of_grams_depend_on_their_bytes_only():
    g = np.random.Generator(np.random.PCG64(3))
    data = np.concatenate([part := g.integers(0, 4, 200).astype(np.uint8), part])
    digests = chunk_dedup.gram_digests(data, np.arange(len(data) - chunk_dedup.GRAM + 1))
    assert (digests[:169] == digests[200:369]).all() and len(np.unique(digests)) == 200
    assert len(chunk_dedup.gram_digests(data[:5], np.zeros(0, np.int64))) == 0


def test_gaps_and_equal_places_are_asked_for_once():
    # row 0: two runs 50 bytes apart along one copy, and two more that lead to one place; row 1: one run from its first byte on
    of, lead = np.array([0, 0, 0, 0, 1]), np.array([1000, 1000, 5000, 5100, 7000])
    start, stop = np.array([100, 182, 400, 300, 0]), np.array([132, 214, 432, 332, 32])
    side, length, place, whole = chunk_dedup.asked(of, lead, start, stop, np.full(5, 3), 64)
    assert side.tolist() == [0, 1, 3, 4, 5, 6, 7, 9] and whole.tolist() == [True, False, False, False, False]
    assert length.tolist() == [-64, 50, 64, -64, 64, -64, 64, 64] and place.tolist()[3:7] == [5400, 5432, 5400, 5432]
    once, nth = chunk_dedup._once(of[side >> 1], place, length)
    assert len(once) == 6 and (place[once][nth] == place).all() and (length[once][nth] == length).all()


def test_strings_are_compared_from_both_ends():
    g = random.Random(11)
    pairs = [(bytes(g.choices(b"ab", (1, 1 + k % 9 * 20), k=n)), n) for k in range(300) for n in [g.choice([0, 1, 7, 64, 300, 900])]]
    others = [bytes(g.choices(b"ab", (1, 150), k=n)) if g.random() < 0.7 else x for x, n in pairs]
    n = np.array([x[1] for x in pairs])
    a = np.cumsum(n) - n
    flat = [np.frombuffer(b"".join(x), np.uint8) for x in ([x for x, _ in pairs], others)]
    ahead, behind = chunk_dedup.compared(flat[0], a, flat[1], a, n, most=500)
    for (x, _), y, i, j in zip(pairs, others, ahead, behind):
        assert i == next((k for k in range(len(x)) if x[k] != y[k]), len(x))
        assert j == next((k for k in range(len(x)) if x[-1 - k] != y[-1 - k]), len(x))


def test_groups_are_not_cut_between_batches():
    batches = [pa.RecordBatch.from_pydict({"row": x}) for x in ([1, 1, 2], [2, 2], [], [2, 5], [7])]
    assert [b.column(0).to_pylist() for b in chunk_dedup._whole(iter(batches))] == [[1, 1], [2, 2, 2, 2], [5], [7]]
