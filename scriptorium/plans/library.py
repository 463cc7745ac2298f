"""The driver's documents table as a stored library: imported once for each table and application, then searched."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scriptorium.plans.engine import Engine
from scriptorium.sources import corpus

_built: dict[tuple[str, str], Engine] = {}


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder in spark.checkpoint.dir, which a cluster shares; without it in a folder of this machine, on a local master only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def library(spark: SparkSession, sf_dir: str, again: bool = False) -> Engine:
    """The library of a table's documents; again: imports them anew."""
    key = spark.sparkContext.applicationId, sf_dir
    if again or key not in _built:
        engine = Engine(spark, shared_folder(spark, "library"))
        rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
        never = F.lit("2000-01-01 00:00:00").cast("timestamp")
        more = {"original_filename": F.concat("document_id", F.lit(".txt")), "content_sha256": F.sha2("text", 256), "page_count": F.lit(None).cast("int"), "extractor_version": F.lit("1"), "created_at": never, "updated_at": never}
        documents = corpus.documents(rows, "text").withColumns(more)
        engine.put_records(documents, corpus.records(rows))
        _built[key] = engine
    return _built[key]
