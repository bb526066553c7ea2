"""From raw documents to packed training sequences.

Each stage is one of the corpus operators, works on all that its predecessor
kept, and is written as Parquet before the next one reads it.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import jaccard, packing, quality, secrets, substrings
from tillroll.llm.queries import vocabulary
from tillroll.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision rejects go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles,
    Jaccard similarity of 0.8 or more)."""
    return jaccard.keep_first(docs, words=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 or more words that start earlier in the corpus are cut."""
    return substrings.remove_repeats(docs, window=20)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by ``[secret]``."""
    return secrets.mask(docs, mark="[secret]")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts with their place in sequences of 4096 tokens."""
    return packing.packed_pieces(docs, vocabulary("word_bpe_49k.json"), 4096, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scan", secret_masking),
    ("best_fit_packing", sequence_packing),
]

#: SQL can't express the learned stages; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
