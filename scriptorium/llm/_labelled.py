"""A bounded, repeatable sample of labelled texts for fitting on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import crc_mod

#: Bytes of texts that a sample may hold; longer texts are passed over for the next rows, never cut.
SAMPLE_BYTES = 256 << 20


def within_bytes(rows: list[tuple[int, int]], most: int, limit: int) -> list[int]:
    """The first `most` ids of (id, bytes) that fit in `limit` bytes together."""
    out: list[int] = []
    for key, size in rows:
        if len(out) < most and size <= limit:
            out.append(key)
            limit -= size
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: dict[int, int]) -> tuple[list[int], pa.ChunkedArray]:
    """Labels (0 or 1) and texts of at most most[label] rows of each label.

    Rows with crc32(id as text) mod folds = held_out are never looked at. The rows taken are the
    first by a hash of the id whose texts fit in SAMPLE_BYTES together, each label's in its share.
    Null ids, labels other than 0 and 1, and null texts are left out; of an id's several labels the
    largest counts, of its several texts the shortest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.where(crc_mod("doc_id", folds) != held_out)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    picked = None
    for y, n in most.items():  # ids alone are ordered, twice as many as are wanted
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * n)
        picked = part if picked is None else picked.union(part)
    sizes = texts.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("size").alias("size"))
    found = sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most 2 * sum(most) numbers
    share = SAMPLE_BYTES // len(most)
    ids = [(i, y) for y, n in most.items() for i in within_bytes([(r.doc_id, r.size) for r in found if r.y == y], n, share)]
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.octet_length("text"), "text")).alias("text"))  # at most sum(most) rows and SAMPLE_BYTES
    out = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("y", "text").toArrow()
    return out["y"].to_pylist(), out["text"]
