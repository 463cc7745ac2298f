"""Segments, tombstones and manifests: how a library's tables lie in a folder.

A commit writes new segments (folders of Parquet files of their own name, sorted by what their table is
looked up by), a list of removed document ids if there are any, and then one manifest that names all
segments. A manifest is put in place by a rename that fails where its number is taken, so of two writers
one wins whole and the other starts again from what it then sees. Readers take the newest manifest.

A removed id hides the rows of older segments only. So a commit costs what it brings, not what the
library holds; `compact` merges segments and removals, `vacuum` deletes what no recent manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removed ids that reads may broadcast; a commit that goes beyond compacts first.
MAX_GONE = 100_000
#: How often a commit starts again when others came first.
ATTEMPTS = 20
#: Tables that are written at the same time.
AT_ONCE = 4


class Busy(RuntimeError):
    """Other writers came first each time."""


@dataclass
class Manifest:
    version: int = 0
    tables: dict[str, list[list]] = field(default_factory=dict)  # [version, segment]
    gone: list[list] = field(default_factory=list)  # [version, segment, tables, ids]


@dataclass
class Change:
    """What a commit adds, and the document ids (document_id) whose older rows it removes from some tables."""

    add: dict[str, DataFrame] = field(default_factory=dict)
    gone: DataFrame | None = None
    of: tuple[str, ...] = ()


class Store:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], order: dict[str, list[str]], blooms: dict[str, list[str]] | None = None):
        self.spark, self.root, self.schemas, self.order, self.blooms = spark, root.rstrip("/"), schemas, order, blooms or {}

    # -- files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read_text(self, *parts: str) -> str | None:
        path = self._path(*parts)
        fs = self._fs(path)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, text: str, *parts: str) -> None:
        path = self._path(*parts)
        stream = self._fs(path).create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, *parts: str) -> None:
        path = self._path(*parts)
        self._fs(path).delete(path, True)

    def bytes_of(self, *parts: str) -> int:
        path = self._path(*parts)
        fs = self._fs(path)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def _put_new(self, text: str, folder: str, name: str) -> bool:
        """Puts a file where none is; False where one is."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        draft = f"_{uuid.uuid4().hex}"
        self.write_text(text, folder, draft)
        source = self._path(folder, draft)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(source, self._path(folder, name), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            self.remove(folder, draft)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise

    # -- tables

    def manifest(self) -> Manifest:
        known = [n for n in self.names("manifest") if n.endswith(".json") and not n.startswith(("_", "."))]
        return Manifest(**json.loads(self.read_text("manifest", known[-1]))) if known else Manifest()

    def table(self, name: str, at: Manifest | None = None) -> DataFrame:
        """The rows of a table that no later commit has removed."""
        at = at or self.manifest()
        segments = at.tables.get(name, [])
        columns = [c.split()[0] for c in self.schemas[name].split(", ")]
        if not segments:
            return self.spark.createDataFrame([], self.schemas[name])
        where = f"{self.root}/{name}"
        rows = self.spark.read.schema(f"{self.schemas[name]}, at_version int, segment string").option("basePath", where).parquet(*[f"{where}/at_version={v}/segment={s}" for v, s in segments])
        oldest = min(v for v, _ in segments)
        gone = [(v, s, n) for v, s, tables, n in at.gone if name in tables and v > oldest]
        if gone:
            folder = f"{self.root}/gone"
            dead = self.spark.read.schema("document_id string, at_version int, segment string").option("basePath", folder).parquet(*[f"{folder}/at_version={v}/segment={s}" for v, s, _ in gone])
            dead = dead.groupBy(F.col("document_id").alias("dead_id")).agg(F.max("at_version").alias("dead_version"))
            dead = F.broadcast(dead) if sum(n for *_, n in gone) <= MAX_GONE else dead
            rows = rows.join(dead, (F.col("document_id") == F.col("dead_id")) & (F.col("at_version") < F.col("dead_version")), "left_anti")
        return rows.select(*columns)

    def staged(self, df: DataFrame) -> DataFrame:
        """df written beside the tables and read back: what several tables are made from is made once."""
        path = f"{self.root}/_staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def report(self, df: DataFrame) -> DataFrame:
        """df written to stay after the commit: what a change refused or found."""
        path = f"{self.root}/reports/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _write(self, df: DataFrame, name: str, version: int) -> str:
        segment = uuid.uuid4().hex
        columns = [c.split()[0] for c in self.schemas[name].split(", ")]
        writer = df.select(*columns).repartitionByRange(*self.order[name]).sortWithinPartitions(*self.order[name]).write
        for column in self.blooms.get(name, []):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.root}/{name}/at_version={version}/segment={segment}")
        return segment

    def _write_all(self, parts: dict[str, DataFrame], version: int) -> list[tuple[str, str]]:
        """Writes segments of several tables side by side: (table, segment)."""
        put = inheritable_thread_target(self.spark)(lambda part: (part[0], self._write(part[1], part[0], version)))
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return list(pool.map(put, parts.items()))

    def commit(self, make: Callable[[Manifest], Change | None]) -> int:
        """Applies the change that make finds for the newest manifest; again for a newer one if others came first."""
        for _ in range(ATTEMPTS):
            base = self.manifest()
            change = make(base)
            if change is None:
                return base.version
            new = base.version + 1
            tables, gone = {k: list(v) for k, v in base.tables.items()}, list(base.gone)
            written = self._write_all(change.add, new)
            for name, segment in written:
                tables.setdefault(name, []).append([new, segment])
            if change.gone is not None:
                segment = uuid.uuid4().hex
                path = f"{self.root}/gone/at_version={new}/segment={segment}"
                change.gone.select("document_id").distinct().write.parquet(path)
                written.append(("gone", segment))
                gone.append([new, segment, list(change.of or self.schemas), self.spark.read.schema("document_id string").parquet(path).count()])
            text = json.dumps({"version": new, "tables": tables, "gone": gone})
            if self._put_new(text, "manifest", f"{new:012d}.json"):
                self.remove("_staging")
                if sum(n for *_, n in gone) > MAX_GONE:
                    self.compact()
                return new
            for name, segment in written:
                self.remove(name, f"at_version={new}", f"segment={segment}")
        raise Busy("other writers came first each time")

    def compact(self) -> int:
        """Each table as one segment without removed rows."""
        for _ in range(ATTEMPTS):
            base = self.manifest()
            new = base.version + 1
            tables = {name: [[new, segment]] for name, segment in self._write_all({name: self.table(name, base) for name in base.tables}, new)}
            if self._put_new(json.dumps({"version": new, "tables": tables, "gone": []}), "manifest", f"{new:012d}.json"):
                return new
            for name, [[_, segment]] in tables.items():
                self.remove(name, f"at_version={new}", f"segment={segment}")
        raise Busy("other writers came first each time")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes segments that the newest `keep` manifests do not name, and older manifests; how many segments.

        Not while others write: a segment whose manifest is still to come looks unnamed.
        """
        known = [n for n in self.names("manifest") if n.endswith(".json") and not n.startswith(("_", "."))]
        named = set()
        for n in known[-keep:]:
            m = json.loads(self.read_text("manifest", n))
            named |= {(name, v, s) for name, segments in m["tables"].items() for v, s in segments} | {("gone", v, s) for v, s, *_ in m["gone"]}
        removed = 0
        for name in (*self.schemas, "gone"):
            for version in self.names(name):
                left = 0
                for segment in self.names(f"{name}/{version}"):
                    if (name, int(version.partition("=")[2]), segment.partition("=")[2]) in named:
                        left += 1
                    else:
                        self.remove(name, version, segment)
                        removed += 1
                if not left:
                    self.remove(name, version)
        for n in known[:-keep]:
            self.remove("manifest", n)
        return removed
