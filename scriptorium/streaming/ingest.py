"""Documents as a stream: new files of a folder go into the library, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.plans.engine import Engine

FILES = "path string, modificationTime timestamp, length long, content binary"


def json_documents(spark: SparkSession, folder: str, pattern: str = "*.json", files_per_batch: int = 1000) -> DataFrame:
    """A stream of semantic documents: original_filename, semantic, content_sha256."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select(name.alias("original_filename"), F.decode("content", "UTF-8").alias("semantic"), F.sha2("content", 256).alias("content_sha256"))


def ingest(engine: Engine, stream: DataFrame, checkpoint: str, once: bool = True, failures: str | None = None) -> StreamingQuery:
    """Feeds a stream to the library; once: what is there now, else on and on.

    A batch that is run again after a failure replaces what it had put in. A document that cannot go
    in, for a repeated or taken title or content too, is a row of failures and never stops the stream.
    failures: where these are written, with their reasons, for each batch.
    """

    def put(batch: DataFrame, number: int) -> None:
        rejected = engine.ingest(batch, replace=True)
        if failures:
            rejected.write.mode("overwrite").parquet(f"{failures}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()
