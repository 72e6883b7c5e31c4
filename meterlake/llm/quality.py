"""Quality classifier: ordinal regression with cumulative links on graded ratings.

Grades are ordered, and the probability of a grade above k is
``sigmoid(w . x - threshold[k])``: all grades share the weights of the hashed text
features, and the thresholds are kept in order. A document gets its expected
grade and the probability of the best grade, by which documents are selected.

Grades come from the labels: 0 toxic, 1 low quality, 2 neither. Features are the
distinct lower-case words of a text, and a few signals of its form (symbols,
repetition, separators, word lengths) in steps, all hashed into 2 ** ``BITS``
weights. Words count once. The model is fitted on at most ``SAMPLE`` labelled
documents, those with the least hash of their id; every document is scored.

Nulls and ties: a null text is empty and has only form features; labels that are
null are left out; a document labelled twice counts twice; equal hashes go to the
smaller id. Without labels of two grades nothing is learned and every document
gets the same grade and is kept. An empty table gives no rows. Texts are read
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passed_on, remembered, slices, texts_of

BITS = 18
SAMPLE = 12_000

GRADES = 3

#: Rare grades count more: by the inverse of their share to this power.
BALANCE = 0.3

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}']+")


class Hashed(dict):
    """Feature number of a word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = number = xxhash.xxh64_intdigest(word) & ((1 << BITS) - 1)
        return number


def features(text: str) -> np.ndarray:
    """Distinct feature numbers of a text."""
    lowered = text.lower()
    words = _WORD.findall(lowered)
    distinct = set(words)
    n, chars = len(words), max(1, len(text))
    letters = sum(map(len, words))
    lines = [x for x in text.split("\n") if x]
    form = {
        "letters": letters / chars, "distinct": len(distinct) / n if n else 1.0, "length": letters / n if n else 0.0,
        "repeated lines": len(set(lines)) / len(lines) if lines else 1.0, "bars": (text.count("|") + text.count("\t")) / chars * 20,
        "symbols": sum(map(text.count, "#$%&*@^~<>{}")) / chars * 10, "digits": sum(map(text.count, "0123456789")) / chars * 10,
    }
    hashed = remembered("feature numbers", Hashed)
    names = [f"\x00{k} {min(20, int(v * 10))}" for k, v in form.items()] + [f"\x00size {min(n, 1 << 20).bit_length()}"]
    return np.unique(np.fromiter(map(hashed.__getitem__, [*distinct, *names]), np.int64))


def fit(rows: list[np.ndarray], grades: np.ndarray, penalty: float = 4e-4, rounds: int = 300, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam on the cumulative-link likelihood.

    Features of fewer than ``least`` documents are left out, and an L1 penalty
    sets the weights of words that do not matter to zero.
    """
    weights = np.zeros(1 << BITS)
    seen = [(grades > k).mean() if len(grades) else 1.0 for k in range(GRADES - 1)]
    logit = [np.log(min(max(s, 1e-3), 1 - 1e-3) / (1 - min(max(s, 1e-3), 1 - 1e-3))) for s in seen]
    thresholds = np.sort(-np.array(logit))
    if len(set(grades.tolist())) < 2:
        return weights, thresholds
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    where, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    often = np.bincount(where, minlength=1 << BITS) >= least
    where, of = where[often[where]], of[often[where]]
    used, where = np.unique(where, return_inverse=True)
    w, first, second = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    balance = np.array([len(grades) / max(1, (grades == g).sum()) for g in range(GRADES)])[grades]
    balance = balance**BALANCE / (balance**BALANCE).mean()
    gap_first, gap_second = np.zeros(GRADES - 1), np.zeros(GRADES - 1)
    for t in range(1, rounds + 1):
        score = np.bincount(of, w[where], len(rows))
        above = 1 / (1 + np.exp(-(score[:, None] - thresholds)))
        full = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], axis=1)
        at = np.arange(len(rows))
        mine = np.maximum(full[at, grades] - full[at, grades + 1], 1e-12)
        slope = full * (1 - full)
        pull = balance * (slope[at, grades] - slope[at, grades + 1]) / mine / len(rows)
        gradient = np.bincount(where, pull[of], len(used))
        push = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            push[k] = (balance * slope[:, k + 1] * ((grades == k).astype(float) - (grades == k + 1)) / mine).mean()
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = 0.05 / (np.sqrt(second / (1 - 0.999**t)) + 1e-5)
        w += step * first / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        gap_first, gap_second = 0.9 * gap_first + 0.1 * push, 0.999 * gap_second + 0.001 * push**2
        thresholds = np.maximum.accumulate(thresholds + 0.05 * (gap_first / (1 - 0.9**t)) / (np.sqrt(gap_second / (1 - 0.999**t)) + 1e-8) + np.arange(GRADES - 1) * 1e-9)
    weights[used] = w
    return weights, thresholds


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fits on at most ``sample`` labelled documents; only their feature numbers reach the driver.

    Of the texts of one id, and of equal labels of it, one counts: that of the least feature numbers.
    """
    graded = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade")
    )
    chosen = graded.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "").astype(np.int32) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in found], pa.binary()), *batch.columns[1:]], names=["features", "doc_id", "grade"])

    # at most ``sample`` rows of a long and an int are broadcast, and as many are collected
    found = docs.join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "grade").mapInArrow(extract, "features binary, doc_id long, grade int")
    rows = found.groupBy("doc_id", "grade").agg(F.min("features").alias("features")).collect()
    rows.sort(key=lambda r: (r["grade"], bytes(r["features"])))
    return fit([np.frombuffer(r["features"], np.int32) for r in rows], np.array([r["grade"] for r in rows], np.int64))


def score(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray, columns: str, names: list[str]) -> DataFrame:
    """Appends expected_grade and p_good to the rows of ``docs``, whose schema is ``columns``; ``names`` are its columns."""
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in slices(batch, "text"):
                total = np.array([weights[features(t.as_py() or "")].sum(dtype=np.float64) for t in held])
                above = 1 / (1 + np.exp(-(total[:, None] - thresholds)))
                yield pa.RecordBatch.from_arrays([*passed_on(batch, first, len(held)), pa.array(above.sum(axis=1).round(9)), pa.array(above[:, -1].round(9))], names=[*names, "expected_grade", "p_good"])

    return docs.select(*names).mapInArrow(run, columns + ", expected_grade double, p_good double")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, expected_grade, p_good, keep) of every document; ``keep`` if the best grade has probability ``least`` or more."""
    texts = texts_of(docs)
    weights, thresholds = train(texts, labels, sample)
    scored = score(texts, weights, thresholds, "doc_id long, text string", ["doc_id", "text"])
    return scored.select("doc_id", "expected_grade", "p_good", (F.col("p_good") >= least).alias("keep"))
