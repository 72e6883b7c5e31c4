"""A training corpus from ``documents``: quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again for the next one. All but the last return the columns of
``documents``; columns that a table has besides are passed on.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.chunk_dedup import cut_texts, repeated
from meterlake.llm.common import row_key, table, texts_of
from meterlake.llm.jaccard import jaccard_components
from meterlake.llm.packing import pack_documents
from meterlake.llm.quality import score, train


def _schema(docs: DataFrame) -> tuple[str, list[str]]:
    """Columns of ``docs`` as a schema string, and their names."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), docs.columns


def _renamed(stage):
    """The stage sees extra columns under names that cannot clash with its own; they get theirs back afterwards."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in ("doc_id", "text", "n_chars") else f"_extra{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), sf_dir)
        return out.select(*(F.col(n).alias(c) for c, n in names.items()))

    return run


@_renamed
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade has a probability of one half or more.

    A null text is scored as an empty one; repeated rows are scored alike and all stay; an empty table stays empty.
    """
    weights, thresholds = train(texts_of(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    schema, names = _schema(docs)
    return score(docs, weights, thresholds, schema, names).where("p_good >= 0.5").select(*names)


@_renamed
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the least id.

    A null id comes behind all others; of equal ids, or if all are null, the text with the least hash stays.
    A document without words is a group of its own. Of rows with equal id and
    text the group keeps one. An empty table stays empty.
    """
    found = table(jaccard_components(docs, n=5, threshold="0.8").select("row", "doc_id", "class"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = found.where("class IS NOT NULL").groupBy("class").agg(first.alias("first")).select(F.col("first.row").alias("_row"))
    kept = kept.unionByName(found.where("class IS NULL").select(F.col("row").alias("_row"))).distinct()
    keyed = docs.withColumn("_row", _key(docs))
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row", "doc_id", "text"]).select(*docs.columns)


@_renamed
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier; ``n_chars`` is counted anew. Documents left with no text go."""
    keyed = texts_of(docs).withColumn("row", row_key())
    full = docs.withColumn("row", _key(docs))
    schema, names = _schema(docs)
    cut = cut_texts(names, schema, full.join(repeated(keyed), "row", "left").select(*names, "ats", "repeats"), 25)
    left = cut.where("n_removed = 0 OR text <> ''")
    if "n_chars" not in names:
        return left.select(*names)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row per piece.

    A null text is empty and gives its end id only; repeated rows are pieces of their own; an empty table gives none.
    """
    return pack_documents(docs)


def _key(docs: DataFrame):
    """``row_key`` over the columns as they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.col("doc_id").cast("long")
    return F.xxhash64(number, F.coalesce(number.cast("string"), F.lit("null")), text)


STAGES = [("quality", quality), ("near_copies", near_copies), ("passages", passages), ("packing", packed)]

#: No stage but the join can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
