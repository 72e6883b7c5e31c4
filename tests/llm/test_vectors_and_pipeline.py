import numpy as np
import pytest

import corpus_pipeline
from meterlake.llm import chunk_dedup, embedding_dedup, queries

from .test_texts import brute_jaccard


def brute_links(rows, threshold):
    sound = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = embedding_dedup.unit(np.array([rows[k][1] for k in sound], float))
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    root, ids = embedding_dedup._roots(len(sound), *np.nonzero(linked)), [rows[k][0] for k in sound]
    out = {i: (0, i) for i, _ in rows}
    for k, r in enumerate(root):
        out[ids[k]] = (int(linked[k].sum()), min(i for i, s in zip(ids, root) if s == r))
    return out


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    g = np.random.default_rng(3)
    centers = g.standard_normal((60, 16))
    rows = [(k, (centers[k % 60] + g.standard_normal(16) * (0.08 if k % 3 else 0.3)).tolist()) for k in range(600)]
    rows += [(1000 + k, rows[5][1]) for k in range(150)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None] * 8), (2003, [float("nan")] * 16), (2004, [1e200] * 16), (2005, [1e-200] * 16), (2006, [1.0]), (2007, [float("inf")] * 16), (2008, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS node", "1 AS label", "'y' AS code")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame).collect()}
    expected = brute_links(rows, 0.9)
    assert set(found) == set(expected)
    assert all(found[k][0] <= expected[k][0] for k in found)
    assert sum(f[0] for f in found.values()) >= 0.97 * sum(e[0] for e in expected.values())
    for k in (2000, 2001, 2002, 2003, 2006, 2007, 2008):
        assert found[k] == (0, k)
    assert found[2005][1] == 2004
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_pipeline_stages(spark, odd_docs, odd_rows):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "passages", "packing"]
    good = stages["quality"](spark, docs, folder)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert sum(i in kept for i, r in labels.items() if r["toxic"] == 1) <= 0.1 * sum(r["toxic"] == 1 for r in labels.values())
    single = stages["near_copies"](spark, odd_docs, folder)
    from fractions import Fraction

    groups = brute_jaccard(odd_rows, 5, Fraction("0.8"))
    expected = {(i, t) for (i, t), (_, _, c) in zip(odd_rows, groups) if i == c}
    assert sorted(map(str, [(r["doc_id"], r["text"] or "") for r in single.collect()])) == sorted(map(str, {(i, t or "") for i, t in expected}))
    cut = stages["passages"](spark, odd_docs, folder)
    assert cut.columns == odd_docs.columns
    same = {(r["doc_id"], r["text"]) for r in chunk_dedup.dedup_passages(odd_docs).collect() if r["n_removed"] == 0 or r["text"]}
    assert {(r["doc_id"], r["text"] or "") for r in cut.collect()} == same
    assert stages["packing"](spark, odd_docs, folder).count() >= len(odd_rows)


def test_run_and_names(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))[0].startswith("op1_") and len(queries.QUERIES) == 13


@pytest.mark.parametrize("name", ["op8_quality", "op10_substring_dedup"])
def test_queries_return_every_document(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200


def test_one_near_copy_stays_whatever_its_ids(spark):
    def texts(name, n):
        base = [f"{name}{k}" for k in range(80)]
        return [" ".join([*base[:k], "changed", *base[k:]]) for k in range(n)]

    rows = [(None, t) for t in texts("null", 3)] + [(5, t) for t in texts("five", 2)] + [(None, t) for t in texts("some", 1)] + [(i, t) for i, t in zip((9, 8), texts("some", 3)[1:])]
    rows += [(None, ""), (7, None), (10, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    kept = [tuple(r) for r in stage(spark, docs, "").collect()]
    of = lambda name: [i for i, t in kept if t and t.split()[-1].startswith(name)]
    assert of("null") == [None] and of("five") == [5] and of("some") == [8]
    assert len(kept) == 6
    assert stage(spark, docs.where("false"), "").count() == 0
