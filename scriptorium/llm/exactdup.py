"""Exact deduplication by a stateful stream: disk-backed keyed state without expiry.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Arrivals
(digest, id, locator) go through a streaming aggregation whose state sits in RocksDB, is keyed by
digest, has no watermark and so never expires: for each digest it retains the largest id, the
content locator (file and row) of that row, and the count. Rows are pre-aggregated before the
shuffle, so a hot digest is one row a task. On hits (a digest with more than one row) the locators
lead to the whole texts, and the distinct texts of each digest are counted, by their bytes and
pre-aggregated too, so a hot text travels once a task; where a digest has several (a collision) its
rows are grouped anew by their bytes. Joins by digest broadcast the digests of more than `HOT` rows,
as far as these are few, and shuffle the others.

Of equal texts the row with the largest id stays; rows with a null id come last; of rows with equal
id and text, the one latest by file and row stays. Extra columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import _bytes as B
from scriptorium.llm._common import PLACE, map_batches, placed_rows, shared_dir, shielded, small, written

#: State on disk; stores take the disk that their rows need, and commits write what has changed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def located(df: DataFrame, id_col: str, text_col: str, placed: bool) -> DataFrame:
    """doc_id, text, file, place of rows; placed: they have their PLACE already."""
    rows = df if placed else placed_rows(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    id_col, text_col = (id_col, text_col) if placed else ("doc_id", "text")
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(PLACE[0]).alias("file"), F.col(PLACE[1]).alias("place"))


def normalised(piece: B.Slice) -> list[bytes]:
    raw = B.LOWER[piece.data].tobytes()
    cuts = piece.offsets.tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _digests(batch: pa.RecordBatch, bits: int) -> dict:
    full = [hashlib.sha256(x).hexdigest() for s in B.slices(batch.column("text")) for x in normalised(s)]
    return {"doc_id": batch.column("doc_id"), "file": batch.column("file"), "place": batch.column("place"), "sha": full, "digest": [x[: bits // 4] for x in full]}


def keyed_state(arrivals: DataFrame) -> DataFrame:
    """The stateful operator, over a stream or a table of doc_id, file, place, digest."""
    return arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "place")).alias("keep"), F.count(F.lit(1)).alias("n"))


def run_stream(arrivals_path: str, schema, state_path: str, spark) -> DataFrame:
    """Feeds what is new in arrivals_path to the state at state_path; returns digest, keep, n as of now.

    Called again with the same paths it goes on from the stored state: what came before is not read again.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    updates = f"{state_path}/updates"
    try:
        keyed_state(spark.readStream.schema(schema).parquet(arrivals_path)).writeStream.outputMode("update").option("checkpointLocation", f"{state_path}/checkpoint").trigger(availableNow=True).foreachBatch(
            lambda batch, i: batch.write.mode("overwrite").parquet(f"{updates}/batch={i}")
        ).start().awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    kept = "digest string, keep struct<doc_id: long, file: string, place: long>, n long, batch int"
    return spark.read.schema(kept).parquet(updates).groupBy("digest").agg(F.max_by("keep", "n").alias("keep"), F.max("n").alias("n"))


#: Rows of a digest from which its join is a broadcast: there are at most rows / HOT such digests.
HOT = 10_000


def by_digest(rows: DataFrame, groups: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows with what groups (one row for each digest, n its rows) say; hot: the groups of many rows."""
    if hot is None:
        return rows.join(groups, "digest")
    return rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(groups.where(F.col("n") <= HOT), "digest"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, placed: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, file, place: one row for each row of df.

    digest_bits: how much of the SHA-256 keys the state; fewer only to test the byte check. placed: df
    has PLACE, as placed_rows gives it.
    """
    spark = df.sparkSession
    docs = located(df, id_col, text_col, placed)
    arrivals = f"{shared_dir(spark, 'arrivals')}"
    form = "doc_id long, file string, place long, sha string, digest string"
    map_batches(docs, lambda x: _digests(x, digest_bits), form).write.parquet(arrivals)
    come = spark.read.schema(form).parquet(arrivals)
    if come.isEmpty():
        return come.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "file", "place")
    state = written(run_stream(arrivals, form, shared_dir(spark, "dedup-state"), spark), "state")

    hot = written(state.where(F.col("n") > HOT), "hot")
    hot = None if hot.isEmpty() else small(hot)
    hits = by_digest(come.select("file", "place", "digest"), state.where("n > 1").select("digest", "n"), None if hot is None else hot.select("digest", "n"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    needed = docs.join(hits.drop("n"), ["file", "place"]).select("digest", "doc_id", "file", "place", F.coalesce(lower, F.lit("")).alias("bytes"))
    several = needed.select("digest", "bytes").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    several = written(several, "collisions")
    if several.isEmpty():
        moved = come.limit(0).select("file", "place", F.struct("doc_id", "file", "place").alias("own"), F.lit(0).cast("long").alias("own_n"))
    else:  # all rows of these digests have groups of their own
        differ = written(needed.join(small(several), "digest"), "collided")
        regrouped = differ.groupBy("digest", "bytes").agg(F.max(F.struct("doc_id", "file", "place")).alias("own"), F.count(F.lit(1)).alias("own_n"))
        moved = differ.join(regrouped, ["digest", "bytes"]).select("file", "place", "own", "own_n")
    out = by_digest(come, state, hot).join(F.broadcast(moved) if several.isEmpty() else moved, ["file", "place"], "left")
    keep, size = F.coalesce("own", "keep"), F.coalesce("own_n", "n")
    kept = (F.col("file") == keep["file"]) & (F.col("place") == keep["place"])
    return out.select("doc_id", keep["doc_id"].alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), "file", "place")


def deduplicated(df: DataFrame, **how) -> DataFrame:
    """df's rows that stay."""
    mine, back = shielded(df)
    rows = placed_rows(mine)
    gone = exact_duplicates(rows, placed=True, **how).where("not kept").select(F.col("file").alias(PLACE[0]), F.col("place").alias(PLACE[1]))
    return rows.join(gone, list(PLACE), "left_anti").select(*back)
