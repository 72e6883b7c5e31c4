"""Vector codes against a quantizer that compares every part with every entry."""

import hashlib

import numpy as np
import pytest

from meterlake.llm import queries, vector_codes
from meterlake.llm.vector_codes import Orchard, compress


def brute(rows, entries):
    """Rows of (id, vector of length divisible by four, label)."""
    kept = sorted(((i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows
                   if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v, _ in kept])
    parts = np.split(x, 4, axis=1)
    books = [p[:entries].copy() for p in parts]

    def nearest(part, book):
        gaps = ((part[:, None] - book[None]) ** 2).sum(axis=2)
        return gaps.argmin(axis=1), gaps.min(axis=1)

    for _ in range(4):
        for part, book in zip(parts, books):
            index, _ = nearest(part, book)
            for e in set(index.tolist()):
                members = part[index == e]
                book[e] = members.sum(axis=0) // len(members)
    found = [nearest(p, b) for p, b in zip(parts, books)]
    errors = sum(d for _, d in found)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + int(e)
    return sorted(((kept[k][0], "".join(f"{f[0][k]:02x}" for f in found), int(errors[k]), total[kept[k][2]], digest) for k in range(len(kept))), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def make(spark, rows):
    schema = "vec_id long, embedding array<double>, label int, dim string, code string, vector int, error long"
    return spark.createDataFrame([(*r, "d", "c", 1, 2) for r in rows], schema)


@pytest.mark.parametrize("entries", [256, 16])
def test_equals_brute_force(spark, monkeypatch, entries):
    g = np.random.default_rng(8)
    centers = g.standard_normal((30, 16))
    rows = [(k, (centers[k % 30] + g.standard_normal(16) * 0.2).tolist(), [None, 1, 2, 3][k % 4]) for k in range(700)]
    rows += [(1000 + k, rows[5][1], 1) for k in range(80)] + [(None, rows[6][1], None), (7, rows[8][1], 2), (7, rows[9][1], 2)]
    rows += [(2000, None, 1), (2001, [1.0, None] * 8, 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] * 16, 9), (2004, [0.0] * 16, 9), (2005, [-0.0001] * 16, 9)]
    monkeypatch.setattr(vector_codes, "ENTRIES", entries)
    assert rows_of(compress(make(spark, rows).repartition(5))) == brute(rows, entries)


def test_few_vectors_and_several_lengths(spark):
    rows = [(3, [0.5] * 8, 1), (1, [0.25] * 8, 1), (2, [1.0] * 4, 1)]
    found = {r[0]: r for r in rows_of(compress(make(spark, [*rows, (9, [], 4), (10, [1.0, 2.0, 3.0, 4.0, 5.0], 4)])))}
    assert [found[k][1] for k in (1, 2, 3, 9, 10)] == ["00000000", "00000000", "01010101", "00000000", "00000000"]
    assert all(r[2] == 0 and r[3] == 0 for r in found.values())
    assert compress(make(spark, rows).where("false")).count() == 0


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        compress(make(spark, [(1, [1e30] * 8, 1)]))


def test_orchard_search_is_exact():
    g = np.random.default_rng(1)
    for width, high in ((1, 5), (2, 4), (3, 50), (16, 1000)):
        book = g.integers(-high, high, (256, width))
        x = np.concatenate([g.integers(-2 * high, 2 * high, (3000, width)), book[:50]])
        index, distance = Orchard(book).nearest(x)
        gaps = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == gaps.argmin(axis=1)).all() and (distance == gaps.min(axis=1)).all()


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert rows_of(queries.QUERIES["op12_vector_codes"](spark, folder)) == brute(rows, 256)
