"""Registered queries of the library's other parts, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import filters, html
from scriptorium.functions import titles as T
from scriptorium.functions.snippets import snippet_column
from scriptorium.operators import search as S
from scriptorium.plans.engine import Engine
from scriptorium.plans.library import library, shared_folder
from scriptorium.plans.queries import _BASE, _SUGGESTIONS, _VOCABULARY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@_register("library_list", f"WITH {_BASE} SELECT document_id, title, row_number() OVER (ORDER BY document_id) AS place FROM docs")
def library_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, newest first; those of one time by id."""
    from pyspark.sql import Window

    listed = library(spark, sf_dir).documents()
    return listed.select("document_id", "title", F.row_number().over(Window.orderBy(F.col("created_at").desc(), "document_id")).cast("long").alias("place"))


@_register("library_load", "SELECT 'doc-' || doc_id AS document_id, sha256(text) AS content_sha256, 'doc-' || doc_id || '.txt' AS original_filename FROM documents WHERE doc_id = 7")
def library_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).table("documents").where("document_id = 'doc-7'").select("document_id", "content_sha256", "original_filename")


@_register(
    "library_sizes",
    f"WITH {_VOCABULARY}, {_SUGGESTIONS.replace(_BASE + ',', '', 1).replace('firsts', 'first_suggestions')} SELECT 'documents' AS name, count(*) AS rows, count(DISTINCT document_id) AS keys FROM docs UNION ALL SELECT 'blocks', count(*), count(DISTINCT document_id) FROM records UNION ALL SELECT 'vocabulary', count(*), count(DISTINCT term) FROM vocabulary UNION ALL SELECT 'suggestions', count(*), count(DISTINCT normalized) FROM suggestions",
)
def library_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).sizes().where("name in ('documents', 'blocks', 'vocabulary', 'suggestions')").select("name", "rows", "keys")


@_register("known_terms", f"WITH {_VOCABULARY} SELECT unnest(['document', 'src7', 'documnt', 'zzzz', 'en']) AS term, unnest(['document', 'src7', 'documnt', 'zzzz', 'en']) IN (SELECT term FROM vocabulary) AS known")
def known_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = library(spark, sf_dir).table("vocabulary")
    return spark.createDataFrame([(t, S.has_term(words, t)) for t in ("document", "src7", "documnt", "zzzz", "en")], "term string, known boolean")


_RAW_FILTERS = [({"document_id": "doc-1"}, True), ({"document_id": "Doc 1"}, False), ({"page": "3"}, True), ({"page": "0"}, False), ({"page": "100001"}, False), ({"page_start": "2", "page_end": "6"}, True), ({"page_start": "6", "page_end": "2"}, False), ({"page_start": "2"}, False), ({"page": "1", "page_end": "2"}, False), ({"page_start": "1", "page_end": "2002"}, False), ({"section_id": "b-0"}, True), ({"block_type": "heading"}, True), ({"block_type": "title"}, False), ({"page": "x"}, False)]


@_register("filters_checked", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {'true' if ok else 'false'})" for i, (_, ok) in enumerate(_RAW_FILTERS)) + ") f(i, accepted)")
def filters_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which raw filters are accepted."""

    def accepted(raw: dict) -> bool:
        try:
            filters.parse(**raw)
        except filters.FilterError:
            return False
        return True

    return spark.createDataFrame([(i, accepted(raw)) for i, (raw, _) in enumerate(_RAW_FILTERS)], "i int, accepted boolean")


@_register(
    "safe_names",
    r"SELECT doc_id, regexp_matches(i, '^[a-z][a-z0-9-]*$') AS id_ok, regexp_matches(a, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AND NOT contains(a, '..') AS asset_ok FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN upper(source) WHEN 2 THEN doc_id || source ELSE source || ' ' || lang END AS i, CASE doc_id % 5 WHEN 0 THEN source || '.png' WHEN 1 THEN '../' || source WHEN 2 THEN source || '..png' WHEN 3 THEN '.' || source ELSE lang || '/' || source END AS a FROM documents)",
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which made-up names may be ids, and assets' names."""
    k4, k5 = F.col("doc_id") % 4, F.col("doc_id") % 5
    ident = F.when(k4 == 0, F.col("source")).when(k4 == 1, F.upper("source")).when(k4 == 2, F.concat(F.col("doc_id").cast("string"), "source")).otherwise(F.concat("source", F.lit(" "), "lang"))
    asset = F.when(k5 == 0, F.concat("source", F.lit(".png"))).when(k5 == 1, F.concat(F.lit("../"), "source")).when(k5 == 2, F.concat("source", F.lit("..png"))).when(k5 == 3, F.concat(F.lit("."), "source")).otherwise(F.concat("lang", F.lit("/"), "source"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.is_safe_id(ident).alias("id_ok"), T.is_safe_asset(asset).alias("asset_ok"))


@_register(
    "snippets",
    f"""WITH {_BASE},
hit AS (SELECT document_id, block_id, line AS t, strpos(lower(line), 'license') - 1 AS a FROM (SELECT document_id, 'b-' || ordinal AS block_id, line FROM lines) WHERE len(string_split(lower(line), 'license')) = 2 AND length(lower(line)) = length(line)),
around AS (SELECT *, greatest(0, a - 96) AS f, least(length(t), a + 7 + 96) AS l FROM hit)
SELECT document_id, block_id, CASE WHEN f > 0 THEN '... ' ELSE '' END || substr(t, f + 1, l - f) || CASE WHEN l < length(t) THEN ' ...' ELSE '' END AS snippet, CAST(a - f + CASE WHEN f > 0 THEN 4 ELSE 0 END AS INTEGER) AS start, CAST(a - f + CASE WHEN f > 0 THEN 4 ELSE 0 END + 7 AS INTEGER) AS "end" FROM around""",
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts around the one place where a block says a word."""
    blocks = library(spark, sf_dir).table("blocks").where((F.size(F.split(F.lower("text"), "license")) == 2) & (F.length(F.lower("text")) == F.length("text")))
    rows = blocks.select("document_id", "block_id", snippet_column(F.col("text"), ("license",)).alias("s"))
    return rows.select("document_id", "block_id", "s.snippet", F.col("s.matches")[0]["start"].alias("start"), F.col("s.matches")[0]["end"].alias("end"))


def _nation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id and semantic JSON made from nations; some ids, titles and records are not as they may be."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey").cast("string")
    block = lambda kind, name, text: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("id"), F.lit(1).alias("pageNumber"), F.lit(1).alias("level"), F.array(F.struct(text.alias("text"))).alias("text"))
    second = F.when(F.col("n_nationkey") % 5 == 3, block("paragraph", "h-1", F.col("n_comment") if "n_comment" in nation.columns else F.lit("words"))).otherwise(block("paragraph", "p-1", F.concat(F.lit("A & B <"), key, F.lit(">"))))
    ident = F.when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit("Nation "), key)).otherwise(F.concat(F.lit("nation-"), key))
    title = F.when(F.col("n_nationkey") % 5 == 2, F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"))).otherwise(F.col("n_name"))
    body = F.struct(F.struct(ident.alias("id"), title.alias("title"), F.lit(1).alias("pageCount")).alias("metadata"), F.array(F.struct(F.lit(1).alias("pageNumber"), F.array(block("heading", "h-1", F.col("n_name")), second).alias("blocks"))).alias("pages"))
    return nation.select(ident.alias("id"), F.to_json(body).alias("semantic"))


_NATIONS = """n AS (SELECT n_nationkey AS k, n_name, CASE n_nationkey % 5 WHEN 1 THEN 'Nation ' || n_nationkey ELSE 'nation-' || n_nationkey END AS document_id, CASE n_nationkey % 5 WHEN 2 THEN 'Region ' || n_regionkey ELSE n_name END AS title FROM nation),
judged AS (
  SELECT *, CASE WHEN k % 5 IN (1, 3) THEN 'bad' WHEN row_number() OVER (PARTITION BY title, k % 5 IN (1, 3) ORDER BY document_id) > 1 THEN 'title repeats in this import' END AS reason FROM n)"""


@_register("library_ingest", f"WITH {_NATIONS} SELECT document_id, title, 'in' AS outcome FROM judged WHERE reason IS NULL UNION ALL SELECT document_id, NULL, CASE WHEN reason = 'bad' THEN CASE WHEN k % 5 = 3 THEN 'repeated block' ELSE 'invalid id' END ELSE reason END FROM judged WHERE reason IS NOT NULL")
def library_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import of good and bad documents into an empty library: who went in, and why the others did not."""
    engine = Engine(spark, shared_folder(spark, "ingest"))
    refused = engine.ingest(_nation_json(spark, sf_dir).select("semantic"))
    reason = F.when(F.lower("reason").contains("invalid"), "invalid id").otherwise(F.col("reason"))
    return engine.documents().select("document_id", "title", F.lit("in").alias("outcome")).union(refused.select("document_id", F.lit(None).cast("string"), reason))


@_register(
    "library_changes",
    f"""WITH {_NATIONS} SELECT document_id, CASE WHEN document_id = 'nation-4' THEN 'A staged title' WHEN document_id = 'nation-9' THEN 'Renamed' ELSE title END AS title, 'h-1' AS block_id, n_name AS text FROM judged WHERE reason IS NULL AND document_id <> 'nation-5'
UNION ALL SELECT document_id, CASE WHEN document_id = 'nation-4' THEN 'A staged title' WHEN document_id = 'nation-9' THEN 'Renamed' ELSE title END, 'p-1', 'A & B <' || k || '>' FROM judged WHERE reason IS NULL AND document_id <> 'nation-5'""",
)
def library_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library after an import, a replacement, a delete, a new title, a staged title, a reindex and a merge of its segments."""
    engine = Engine(spark, shared_folder(spark, "changes"))
    rows = _nation_json(spark, sf_dir)
    engine.ingest(rows.select("semantic"))
    engine.ingest(rows.where("id in ('nation-0', 'nation-5')").select("semantic"), replace=True)
    engine.delete(["nation-5", "nation-none"])
    engine.retitle("nation-9", "Renamed")
    engine.stage_title("nation-4", "A staged title")
    engine.publish_title("nation-4")
    engine.reindex(["nation-9"])
    engine.store.compact()
    return engine.table("documents").select("document_id", "title").join(engine.table("blocks").select("document_id", "block_id", "text"), "document_id")


@_register("html_pages", f"""WITH {_NATIONS} SELECT document_id, '<article><section id="page-1"><h1 id="h-1">' || n_name || '</h1><p id="p-1">A &amp; B &lt;' || k || '&gt;</p></section></article>' AS html FROM n WHERE k % 5 NOT IN (1, 3)""")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic documents as escaped HTML."""
    return _nation_json(spark, sf_dir).where(T.is_safe_id(F.col("id")) & ~F.col("semantic").rlike('"id":"h-1".*"id":"h-1"')).select(F.col("id").alias("document_id"), html.rendered(F.col("semantic")).alias("html"))


@_register("library_fetch", "SELECT 'doc-' || doc_id AS document_id, 'doc-' || doc_id AS block_id FROM documents WHERE doc_id IN (3, 5) ORDER BY 1")
def library_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents named by the postings of a code in their titles, read by id."""
    from scriptorium.functions import query as Q

    node = Q.Any_((Q.Words(("document", "3")), Q.Words(("document", "5"))))
    rows = library(spark, sf_dir).stage(Q.parse("document 3 OR document 5"), "direct", node=node)
    return rows.where("block_type = 'document-title'").select("document_id", "block_id")
