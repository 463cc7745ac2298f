"""The driver's documents table as a search corpus: every non-empty line of a text is a block.

The first line is the document's first block, whole; its first 80 characters are the heading (a
label) of the document's only section. Ten lines make a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.lexemes import collapse

LINES_PER_PAGE = 10
HEADING_CHARACTERS = 80


def documents(rows: DataFrame, *more: str) -> DataFrame:
    """document_id, title, and more columns of the rows."""
    return rows.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_id"), F.concat_ws(" ", "lang", "source", F.lit("document"), F.col("doc_id").cast("string")).alias("title"), *more)


def records(rows: DataFrame) -> DataFrame:
    """Search records (operators.records.RECORD) of the texts' lines."""
    lines = F.filter(F.transform(F.split("text", "\n"), collapse), lambda x: F.length(x) > 0)
    base = rows.select("doc_id", F.concat_ws(" ", "lang", "source", F.lit("document"), F.col("doc_id").cast("string")).alias("document_title"), lines.alias("lines"))
    flat = base.select("doc_id", "document_title", F.substring(F.get("lines", F.lit(0)), 1, HEADING_CHARACTERS).alias("heading"), F.posexplode("lines").alias("ordinal", "text"))
    first = F.col("ordinal") == 0
    return flat.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_id"), "document_title", F.lit("b-0").alias("section_id"), F.concat(F.lit("b-"), F.col("ordinal")).alias("block_id"),
        "heading", F.array("heading").alias("heading_path"), (F.floor(F.col("ordinal") / LINES_PER_PAGE) + 1).cast("int").alias("page_number"),
        F.when(first, "heading").otherwise("paragraph").alias("block_type"), "text",
        F.lit(None).cast("string").alias("table_header"), F.lit(None).cast("string").alias("row_header"), "ordinal",
    )
