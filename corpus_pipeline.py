"""The corpus pipeline: documents in, sampled piece sequences of a clean, deduplicated, mixed corpus out.

Every stage but the last returns the columns of documents. Null texts count as empty everywhere;
what each stage does with null ids, ties and repeated rows is said by its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import exactdup, mixing, neardup, pieces, quality
from scriptorium.llm._common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exactdup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, a similarity of 0.8 (op5's contract says four words)."""
    return neardup.deduplicated(docs, width=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, weights=(1, 2, 3), limit=3)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document."""
    return pieces.encode(docs, k=2)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix", mix_stage),
    ("pieces", pieces_stage),
]

#: A trained classifier and sampled segmentations have no SQL. Tests compare the exact and near stages with
#: plain versions over all pairs, the mix with its constraints, and the pieces with the texts they decode to.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
