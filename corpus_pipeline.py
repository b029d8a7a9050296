"""The corpus pipeline: stages over ``documents``, each written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.llm import decontam, neardup, packing, pii, quality
from siftlode.llm.shared import stored, work_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what a quality rule rejects."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate component (similarity of 0.8 or more)."""
    return neardup.without_near_duplicates(docs, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with an item of ``benchmark``."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=1)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace spans of personal data, and count characters again."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the padded sequences of 4096 tokens to a table in the shared folder; the pieces of all documents, with their ids, as read from it."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), width=2)
    found = packing.pieces_of(packing.written(packing.packed(cut), width=2), width=2)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality_rules", good_documents),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed_sequences),
]
#: SQL cannot express minwise trees, the trained span classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order, each one's result a table that the next one reads."""
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
