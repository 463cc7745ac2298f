"""Registered queries that read files made from the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import titles as T
from scriptorium.operators import records as R
from scriptorium.plans import pdf_files as P
from scriptorium.sources import pdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


#: Files that one task makes and reads.
FILES_A_TASK = 2000


def _files(rows: DataFrame, make: Callable[..., bytes], *columns: str, path) -> DataFrame:
    """path, content: one file for each row. The rows are dealt out first: a table of many short rows may be one split."""

    @F.pandas_udf("binary")
    def made(*parts: pd.Series) -> pd.Series:
        return pd.Series([make(*x) for x in zip(*parts)])

    tasks = max(1, -(-rows.count() // FILES_A_TASK))
    rows = rows.select(path.alias("__path"), *columns).repartition(tasks)
    return rows.select(F.col("__path").alias("path"), made(*columns).alias("content"))


def _named(files: DataFrame) -> DataFrame:
    """document_id, title, semantic of files that can be read."""
    read = pdf.documents(files).where("error_code is null")
    return read.select(F.regexp_extract("original_filename", r"^(.*)\.pdf$", 1).alias("document_id"), F.lit("t").alias("title"), "semantic", "assets")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rows = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    rows = rows.withColumns({"key": F.col("n_nationkey").cast("int"), "link": F.concat(F.when(F.col("n_nationkey") % 2 == 0, "https://x.example/").otherwise("javascript:"), F.col("n_nationkey").cast("string"))})
    return _files(rows, P.tagged_file, "n_name", "r_name", "key", "link", path=F.concat(F.lit("in/nation-"), F.col("n_nationkey").cast("string"), F.lit(".pdf")))


_N = "n AS (SELECT 'nation-' || n_nationkey AS document_id, n_name AS t, r_name AS r, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey)"


@_register(
    "pdf_tagged",
    f"""WITH {_N}
SELECT document_id, 'heading' AS block_type, t AS text, CAST(NULL AS VARCHAR) AS table_header, t AS heading FROM n
UNION ALL SELECT document_id, 'paragraph', t || ' lies in ' || r, NULL, t FROM n
UNION ALL SELECT document_id, 'list-item', '1. first of ' || t, NULL, t FROM n
UNION ALL SELECT document_id, 'list-item', '2. second of ' || t, NULL, t FROM n
UNION ALL SELECT document_id, 'table-cell', 'Name', 'Name', t FROM n
UNION ALL SELECT document_id, 'table-cell', 'Key', 'Key', t FROM n
UNION ALL SELECT document_id, 'table-cell', t, 'Name', t FROM n
UNION ALL SELECT document_id, 'table-cell', CAST(k AS VARCHAR), 'Key', t FROM n
UNION ALL SELECT document_id, 'figure-caption', 'The flag of ' || t, NULL, t FROM n""",
)
def pdf_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged, compressed files as search records: headings, links, lists, tables, captions."""
    flat = R.split_failures(R.flatten(_named(_nations(spark, sf_dir))))[0]
    return flat.select("document_id", "block_type", "text", "table_header", "heading")


@_register("pdf_outline", f"WITH {_N} SELECT document_id, 1 AS level, t AS title, 1 AS target_page, CAST(NULL AS VARCHAR) AS target_href FROM n UNION ALL SELECT document_id, 2, r, NULL, CASE WHEN k % 2 = 0 THEN 'https://x.example/' || k END FROM n")
def pdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines, flattened: targets by name, safe addresses only."""
    return R.flatten_outline(_named(_nations(spark, sf_dir))).select("document_id", "level", "title", "target_page", "target_href")


@_register(
    "pdf_images",
    f"""WITH {_N} SELECT document_id, 'img-1' AS id, 'image/png' AS mime_type, 3 AS width, 2 AS height, CAST(100 + k AS DOUBLE) AS x, CAST(360 AS DOUBLE) AS y, 'Flag of ' || t AS alt_text,
repeat('00' || repeat(lower(printf('%02x%02x07ff', CAST(k % 256 AS INTEGER), CAST(length(t) % 256 AS INTEGER))), 3), 2) AS pixels FROM n""",
)
def pdf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with where they stand and what their PNG holds: rows of a filter byte and RGBA pixels."""

    @F.pandas_udf("string")
    def pixels(content: pd.Series) -> pd.Series:
        return content.map(lambda b: zlib.decompress(b[b.index(b"IDAT") + 4 : b.index(b"IEND") - 8]).hex())

    @F.pandas_udf("x double, y double, alt_text string")
    def placed(semantic: pd.Series) -> pd.DataFrame:
        out = []
        for text in semantic:
            document = json.loads(text)
            figure = next(b for b in document["pages"][0]["blocks"] if b["type"] == "figure")
            asset = next(a for a in document["assets"] if a["id"] == figure["imageId"])
            out.append((asset["placements"][0]["x"], asset["placements"][0]["y"], figure["altText"]))
        return pd.DataFrame(out, columns=["x", "y", "alt_text"])

    rows = _named(_nations(spark, sf_dir)).select("document_id", F.explode("assets").alias("a"), placed("semantic").alias("p"))
    return rows.select("document_id", "a.id", "a.mime_type", "a.width", "a.height", "p.x", "p.y", "p.alt_text", pixels("a.content").alias("pixels"))


@_register(
    "pdf_fonts",
    "SELECT 'customer-' || c_custkey AS document_id, s AS text, CAST(20 AS DOUBLE) AS x, CAST(100 AS DOUBLE) AS y, 20 + 5.0 * length(s) AS end_x, CAST(10 AS DOUBLE) AS size FROM (SELECT c_custkey, 'Żółć ' || c_name || ' €' AS s FROM customer)",
)
def pdf_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned text in composite fonts: characters by the font's own map, ends by its widths."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("said", F.concat(F.lit("Żółć "), "c_name", F.lit(" €")))
    found = pdf.fragments(_files(rows, P.composite_file, "said", path=F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))))
    return found.select(F.col("path").alias("document_id"), "text", "x", "y", "end_x", "size")


@_register(
    "pdf_columns",
    """WITH s AS (SELECT 'supplier-' || s_suppkey AS document_id, s_suppkey AS k, s_name AS t FROM supplier)
SELECT document_id, 0 AS ordinal, 'heading' AS block_type, t AS text FROM s
UNION ALL SELECT document_id, 1 + 2 * row + side, 'paragraph', CASE side WHEN 0 THEN 'left ' ELSE 'right ' END || CASE row WHEN 0 THEN 'one ' || k WHEN 1 THEN 'two ' || k ELSE 'three' END
FROM s, (SELECT unnest([0, 1, 2]) AS row), (SELECT unnest([0, 1]) AS side)""",
)
def pdf_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untagged pages of two columns under a headline: a row is cut where the gap is wide, and its parts stay apart."""

    def make(name: str, key: int) -> bytes:
        lines = [(20, 370, 20, name)]
        for x, side in ((20, "left"), (220, "right")):
            lines += [(x, 330, 10, f"{side} one {key}"), (x, 318, 10, f"{side} two {key}"), (x, 306, 10, f"{side} three")]
        return P.page_file(P.lines_at(sorted(lines, key=lambda line: -line[1])))  # row by row, across the columns

    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    flat = R.split_failures(R.flatten(_named(_files(rows, make, "s_name", "s_suppkey", path=F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string"), F.lit(".pdf"))))))[0]
    return flat.select("document_id", "ordinal", "block_type", "text")


@_register(
    "pdf_metadata",
    """SELECT 'part-' || p_partkey AS document_id, CASE WHEN p_partkey % 2 = 0 THEN 'New ' || p_name ELSE p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'maker ' || p_partkey END AS producer,
1 AS pages, CASE WHEN p_partkey % 2 = 0 THEN 'New ' || p_name ELSE p_name END AS chosen, 'pdf-metadata' AS source FROM part""",
)
def pdf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and producers; every other file has a newer section, which wins."""

    def make(key: int, name: str) -> bytes:
        first = P.page_file(P.lines_at([(20, 300, 10, "a page")]), {"Title": name, "Producer": f"maker {key}"})
        return P.updated(first, 6, b"<< /Title %s >>" % P.literal(f"New {name}")) if key % 2 == 0 else first

    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    read = _named(_files(rows, make, "p_partkey", "p_name", path=F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(".pdf"))))
    meta = F.from_json("semantic", "metadata struct<title: string, producer: string, pageCount: int>")["metadata"]
    chosen = T.select_title(F.lit(None).cast("string"), meta["title"], F.lit(None).cast("string"), F.col("document_id"))
    return read.select("document_id", meta["title"].alias("title"), meta["producer"].alias("producer"), meta["pageCount"].alias("pages"), chosen["title"].alias("chosen"), chosen["source"].alias("source"))


@_register(
    "pdf_failures",
    "SELECT 'f-' || s_suppkey || '.pdf' AS original_filename, CASE s_suppkey % 6 WHEN 0 THEN 'invalid-header' WHEN 1 THEN 'corrupt-structure' WHEN 2 THEN 'unsupported-encryption' WHEN 3 THEN 'corrupt-structure' WHEN 4 THEN 'limit-exceeded' END AS error_code FROM supplier",
)
def pdf_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no PDF, cut off, encrypted, without a page tree, or blown up fail alone, each with its reason."""
    good = P.page_file(P.lines_at([(20, 300, 10, "a page")]))
    bad = {
        0: b"no such file", 1: good[: len(good) // 2], 2: good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 5 0 R"), 3: b"%PDF-1.4\nstartxref\n9\n%%EOF",
        4: P.plain({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] /Contents 4 0 R >>", 4: P.stream(b" " * 3_000_000)}),
    }
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    files = _files(rows, lambda k: bad.get(int(k) % 6, good), "s_suppkey", path=F.concat(F.lit("in/f-"), F.col("s_suppkey").cast("string"), F.lit(".pdf")))
    return pdf.documents(files).select("original_filename", "error_code")
