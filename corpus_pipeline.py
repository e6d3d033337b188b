"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import cut
from tesserae.llm.neardup import reject_near_duplicates
from tesserae.llm.packing import pack_documents
from tesserae.llm.quality import reject_low_quality
from tesserae.llm.suffixes import cut_repeats
from tesserae.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of severity grade 0; null and empty texts stay. Other columns pass."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass base rules and fences; null and empty texts go. Other columns pass."""
    return reject_low_quality(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies; those without words are in none. Other columns pass."""
    return reject_near_duplicates(docs, shingle=2, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated 100-byte strings, null ones empty; no row goes. Other columns pass."""
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 4096 tokens; an empty text is the end token alone."""
    return pack_documents(docs, capacity=4096)


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", packing),
]

#: SQL can express neither the trained model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
