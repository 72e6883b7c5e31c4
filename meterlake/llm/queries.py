"""The queries of this subpackage over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_tokens import token_files
from .bpe import encode_texts
from .chat import format_conversations, read_back
from .chunk_dedup import dedup_passages
from .embedding_dedup import near_duplicates
from .fingerprints import fingerprint
from .jaccard import jaccard_components
from .licenses import scan_licenses
from .packing import pack_documents
from .quality import classify
from .repair import damaged, repair_report
from .suffix_dedup import remove_repeats
from .vector_codes import compress


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_passages(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_chunks", "n_repeated", "n_removed", "spans", F.octet_length("text").cast("long").alias("n_kept"), F.sha2("text", 256).alias("kept_sha256"), "text")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of marks."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(hard)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": lambda spark, d: scan_licenses(_documents(spark, d)),
    "op2_fingerprints": lambda spark, d: fingerprint(_documents(spark, d)),
    "op3_token_files": lambda spark, d: token_files(_documents(spark, d)),
    "op4_bpe": lambda spark, d: encode_texts(_documents(spark, d), digest=True),
    "op5_suffix_dedup": lambda spark, d: remove_repeats(_documents(spark, d), digest=True),
    "op6_embedding_dedup": lambda spark, d: near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op7_packing": lambda spark, d: pack_documents(_documents(spark, d)),
    "op8_quality": lambda spark, d: classify(_documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op9_ngram_jaccard": lambda spark, d: jaccard_components(_documents(spark, d), n=4, threshold="0.85").select("doc_id", "n_shingles", "component_id"),
    "op10_substring_dedup": op10_substring_dedup,
    "op11_chat_format": op11_chat_format,
    "op12_vector_codes": lambda spark, d: compress(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op13_conversation_repair": lambda spark, d: repair_report(damaged(spark.read.parquet(f"{d}/conversations.parquet")), alive="alive"),
}

#: What SQL can say exactly over whole tables in reasonable time.
ORACLES: dict[str, str] = {}
