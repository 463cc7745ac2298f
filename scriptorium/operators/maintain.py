"""Keeping an index: deletes, new titles, conflicts, and what a reindex would change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import identifiers as I


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of documents that are not in gone (document_id)."""
    return rows.join(gone.select("document_id").distinct(), "document_id", "left_anti")


def retitled(documents: DataFrame, document_id: str, title: str) -> DataFrame:
    return documents.withColumn("title", F.when(F.col("document_id") == document_id, title).otherwise(F.col("title")))


def conflicts(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """Values that should be unique and are not: key, copies, first_id."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")


def reindex_changes(blocks: DataFrame) -> DataFrame:
    """Blocks whose stored technical variants are not what their fields say now, with the new ones."""
    fresh = I.variants(*[F.col(c) for c in ("heading", "table_header", "row_header", "text")])
    return blocks.withColumn("fresh", fresh).where(~F.col("fresh").eqNullSafe(F.col("technical_variants")))
