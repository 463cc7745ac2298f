"""What the operators share: batch mapping, the shared folder, table paths."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "scriptorium_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch that returns columns by name, or yields them part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                for part in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_pydict(part)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows of keys and numbers that may be broadcast: about 10 MB.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A written table of few short columns, to be broadcast where it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder in the shared checkpoint folder; where none is set, in a folder of this machine, on a local master only."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not top:
        set_dir = context._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            top = set_dir.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            top = "file:///tmp/checkpoints"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: no lineage, and it survives lost executors.

    files: how many a table of few short rows goes into at most. Without native libraries a local file
    system starts a process for each file that is made.
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    (df.repartition(files) if files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.pop("_written_at", None):
            drop_dir(df.sparkSession, path)


#: Where a row of a file scan lies.
PLACE = ("__file", "__place")


def shielded(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df with other names for its own columns that are called as PLACE is, and how to select its columns as they were."""
    own = {c: f"__own_{c}" for c in df.columns if c.lower() in PLACE}
    return df.withColumnsRenamed(own), [F.col(f"`{own.get(c, c)}`").alias(c) for c in df.columns]


def placed_rows(df: DataFrame) -> DataFrame:
    """df with PLACE: a file scan as it is, anything else staged in the shared folder first."""
    where = [F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1])]
    try:
        return df.select("*", *where)
    except AnalysisException:
        return written(df, "rows").select("*", *where)


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def crc_mod(id_col: str, n: int):
    """crc32(id as text) mod n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % n
