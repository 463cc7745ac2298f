"""The registered queries of the search engine over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import html
from scriptorium.functions import query as Q
from scriptorium.functions import titles as T
from scriptorium.functions.filters import Filters
from scriptorium.functions.lexemes import collapse
from scriptorium.operators import index, maintain
from scriptorium.operators import search as S
from scriptorium.plans.library import library
from scriptorium.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(_rows(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.records(_rows(spark, sf_dir))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_blocks(_records(spark, sf_dir), english=False)


def _register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- SQL of the shared parts ---------------------------------------------------------------------

_WHITE = r"[\x09-\x0D\x20]+"
_LEX = r"\p{L}[\p{L}\p{N}]*(?:-\p{L}[\p{L}\p{N}]*)*|\p{N}+\p{L}[\p{L}\p{N}]*|-?\p{N}+(?:\.\p{N}+)*"


def _sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WHITE}', ' ', 'g'))"


def _sql_lex(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(lower({x}), '{_LEX}'), lambda t: CASE WHEN strpos(t, '-') > 1 THEN list_concat([t], string_split(t, '-')) ELSE [t] END))"


#: (text with every separator doubled, so that neighbours do not share one)
def _sql_identifiers(x: str) -> str:
    doubled = f"regexp_replace(coalesce({x}, ''), '([^A-Za-z0-9])', '\\1\\1', 'g')"
    found = f"regexp_extract_all(' ' || {doubled} || ' ', '[^A-Za-z0-9]([A-Z]{{1,4}}(?:--|  )?[0-9]{{1,6}})[^A-Za-z0-9]', 1)"
    return f"list_transform({found}, lambda t: regexp_replace(t, '[- ]', '', 'g'))"


_TITLE = "concat_ws(' ', lang, source, 'document', CAST(doc_id AS VARCHAR))"
_BASE = rf"""
docs AS (SELECT 'doc-' || doc_id AS document_id, {_TITLE} AS title, text FROM documents),
cut AS (SELECT document_id, title, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_sql_collapse('x')}), lambda x: length(x) > 0) AS l FROM docs),
lines AS (SELECT document_id, title AS document_title, left(l[1], 80) AS heading, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS ordinal FROM cut),
records AS (
  SELECT document_id, document_title, 'b-0' AS section_id, 'b-' || ordinal AS block_id, heading, CAST(ordinal // 10 + 1 AS INTEGER) AS page_number,
    CASE WHEN ordinal = 0 THEN 'heading' ELSE 'paragraph' END AS block_type, line AS text, ordinal
  FROM lines)
"""
_BLOCKS = rf"""{_BASE},
named AS (SELECT *, list_concat({_sql_identifiers('heading')}, {_sql_identifiers('text')}) AS ids FROM records),
kept_ids AS (SELECT *, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS own FROM named),
varied AS (
  SELECT * EXCLUDE (ids, own), array_to_string(flatten(list_transform(own[:40], lambda c: [regexp_replace(c, '^([A-Z]+)([0-9]+)$', '\1-\2'), c, regexp_replace(c, '^([A-Z]+)([0-9]+)$', '\1 \2')])), ' ') AS technical_variants
  FROM kept_ids),
worded AS (SELECT *, list_concat(list_concat({_sql_lex('heading')}, {_sql_lex('text')}), {_sql_lex('technical_variants')}) AS words FROM varied),
blocks AS (SELECT *, chr(1) || array_to_string(words, chr(1)) || CASE WHEN len(words) > 0 THEN chr(1) ELSE '' END AS lexed FROM worded),
title_words AS (SELECT *, {_sql_lex('title')} AS words FROM docs),
titles AS (
  SELECT document_id, title AS document_title, document_id AS section_id, document_id AS block_id, title AS heading, 1 AS page_number, 'document-title' AS block_type, title AS text,
    chr(1) || array_to_string(words, chr(1)) || chr(1) AS lexed FROM title_words),
searched AS (
  SELECT document_id, document_title, section_id, block_id, page_number, block_type, text, lexed FROM blocks
  UNION ALL SELECT document_id, document_title, section_id, block_id, page_number, block_type, text, lexed FROM titles)
"""


def _sql_condition(node) -> str:
    if isinstance(node, Q.Words):
        text = "chr(1) || '" + "' || chr(1) || '".join(node.lexemes) + "'" + ("" if node.prefix else " || chr(1)")
        return f"contains(lexed, {text})"
    if isinstance(node, Q.Not):
        return f"NOT {_sql_condition(node.part)}"
    return "(" + (" AND " if isinstance(node, Q.All) else " OR ").join(map(_sql_condition, node.parts)) + ")"


def _sql_stage(query: Q.Query, node, match_class: str, limit: int, where: str = "true") -> str:
    from scriptorium.functions import ranking as R

    n = len(query.terms)
    places = [f"strpos(low, '{t}')" for t in query.terms]
    matched = " + ".join(f"CASE WHEN {p} > 0 THEN 1 ELSE 0 END" for p in places)
    phrases = [" ".join(query.terms), *(" ".join(p) for p in query.phrases)]
    phrase = " OR ".join(f"contains(low, '{p}')" for p in phrases)
    near = " AND ".join([f"{p} > 0" for p in places] + [f"{a} <= {b}" for a, b in zip(places, places[1:])] + [f"{places[-1]} - {places[0]} <= {R.NEAR_WINDOW}"]) if n > 1 else "false"
    return rf"""
hit AS (SELECT *, {_sql_collapse('text')} AS shown, lower({_sql_collapse('text')}) AS low FROM searched WHERE {_sql_condition(node)} AND {where}),
signals AS (
  SELECT *, CASE block_type WHEN 'document-title' THEN 100.0 WHEN 'heading' THEN 100.0 WHEN 'table-cell' THEN 60.0 ELSE 40.0 END AS base,
    CAST({matched} AS DOUBLE) / {n}.0 AS coverage, ({phrase}) AS phrase, ({near}) AS near, length(shown) AS size FROM hit),
ranked AS (
  SELECT *, floor(((CAST(base AS DOUBLE) + CAST(base AS DOUBLE) * 0.5 * coverage + CASE WHEN phrase THEN CAST(base AS DOUBLE) * 0.75 ELSE 0.0 END
    + CASE WHEN near AND NOT phrase THEN CAST(base AS DOUBLE) * CAST(0.35 AS DOUBLE) ELSE 0.0 END) * CAST({R.CLASSES[match_class]} AS DOUBLE)
    / CASE WHEN size <= 240 THEN CAST(1 AS DOUBLE) ELSE 1 + CAST(0.18 AS DOUBLE) * log2(CAST(size AS DOUBLE) / 240) END) * 1000000 + 0.5) / 1000000 AS rank FROM signals),
top AS (SELECT * FROM ranked ORDER BY rank DESC, document_title, page_number, block_id LIMIT {limit})
"""


_SHOWN = ["document_id", "document_title", "block_id", "block_type", "page_number", "rank"]


def _stage_query(name: str, text: str, match_class: str, filters: Filters = Filters(), where: str = "true", node: Callable | None = None) -> None:
    query = Q.parse(text)
    build = node or {"direct": Q.strict, "prefix": Q.prefix, "partial": Q.partial}[match_class]
    tree = build(query)
    limit = min(S.STAGE_CAPS[match_class], S.MAX_RESULTS * S.CANDIDATES_PER_RESULT)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return library(spark, sf_dir).stage(query, match_class, filters, node=tree).select(*_SHOWN)

    QUERIES[name] = run
    ORACLES[name] = f"WITH {_BLOCKS}, {_sql_stage(query, tree, match_class, limit, where)} SELECT {', '.join(_SHOWN)} FROM top"


# -- index ---------------------------------------------------------------------------------------


@_register("search_records", f"WITH {_BASE} SELECT document_id, document_title, section_id, block_id, heading, page_number, block_type, text FROM records")
def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("document_id", "document_title", "section_id", "block_id", "heading", "page_number", "block_type", "text")


@_register("technical_variants", f"WITH {_BLOCKS} SELECT document_id, block_id, technical_variants, lexed AS lex_simple FROM blocks")
def technical_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("document_id", "block_id", "technical_variants", "lex_simple")


@_register("postings", f"WITH {_BLOCKS}, flat AS (SELECT document_id, block_id, unnest(words) AS lexeme FROM blocks) SELECT lexeme, count(DISTINCT document_id || '/' || block_id) AS blocks, count(*) AS places FROM flat GROUP BY lexeme")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = index.postings(_blocks(spark, sf_dir))
    return lists.groupBy("lexeme").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("positions")).alias("places"))


_W = "[a-z0-9]+(?:-[a-z0-9]+)*"
_VOCABULARY = rf"""{_BASE},
from_titles AS (SELECT document_id, -1 AS record, unnest(regexp_extract_all(lower(title), '{_W}')) AS term, generate_subscripts(regexp_extract_all(lower(title), '{_W}'), 1) - 1 AS place FROM docs),
parts AS (SELECT document_id, ordinal AS record, list_concat(regexp_extract_all(lower(heading), '{_W}'), list_transform({_sql_identifiers('text')}, lambda c: lower(c))) AS p FROM records),
from_records AS (SELECT document_id, record, unnest(p) AS term, generate_subscripts(p, 1) - 1 AS place FROM parts),
good AS (SELECT * FROM (SELECT document_id, record, term, place FROM from_titles UNION ALL SELECT document_id, record, term, place FROM from_records) WHERE length(term) BETWEEN 3 AND 40),
firsts AS (SELECT document_id, term, min((record, place)) AS f FROM good GROUP BY document_id, term),
vocabulary AS (SELECT term, document_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY f) AS n FROM firsts) WHERE n <= 200)
"""


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.vocabulary(_records(spark, sf_dir), _documents(spark, sf_dir))


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.suggestions(_records(spark, sf_dir), _documents(spark, sf_dir))


@_register("vocabulary", f"WITH {_VOCABULARY} SELECT term, document_id FROM vocabulary")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


_SUGGESTIONS = rf"""{_BASE},
ids AS (SELECT document_id, ordinal, list_concat({_sql_identifiers('heading')}, {_sql_identifiers('text')}) AS c FROM records),
flat_ids AS (SELECT document_id, ordinal, unnest(c) AS c, generate_subscripts(c, 1) AS place FROM ids),
every AS (
  SELECT document_id, 0 AS stage, 0 AS record, 0 AS place, 'title' AS suggestion_type, title AS text FROM docs
  UNION ALL SELECT document_id, 1, ordinal, 0, 'heading', heading FROM records WHERE block_type = 'heading'
  UNION ALL SELECT document_id, 2, ordinal, place, 'technical', regexp_replace(c, '^([A-Z]+)([0-9]+)$', '\1-\2') FROM flat_ids),
plain AS (SELECT * REPLACE ({_sql_collapse('text')} AS text), lower({_sql_collapse('text')}) AS normalized FROM every),
firsts AS (SELECT document_id, suggestion_type, normalized, min((stage, record, place)) AS f, arg_min(text, (stage, record, place)) AS text FROM plain WHERE length(text) BETWEEN 1 AND 200 GROUP BY document_id, suggestion_type, normalized),
suggestions AS (SELECT document_id, suggestion_type, text, normalized FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY f) AS n FROM firsts) WHERE n <= 60)
"""


@_register("suggestions", f"WITH {_SUGGESTIONS} SELECT document_id, suggestion_type, text, normalized FROM suggestions")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggestions(spark, sf_dir)


@_register("index_counts", f"WITH {_VOCABULARY} SELECT (SELECT count(DISTINCT term) FROM vocabulary) AS terms, (SELECT count(*) FROM vocabulary) AS vocabulary_rows, (SELECT count(*) FROM records) AS blocks")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _vocabulary(spark, sf_dir).agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("vocabulary_rows"))
    return words.crossJoin(_records(spark, sf_dir).agg(F.count(F.lit(1)).alias("blocks")))  # one row each


# -- search --------------------------------------------------------------------------------------

_stage_query("search_strict", "public license", "direct")
_stage_query("search_phrase", '"mit license" released', "direct")
_stage_query("search_or", "apache OR gnu license", "direct")
_stage_query("search_exclude", "license -gnu -apache", "direct")
_stage_query("search_prefix", "licensed und", "prefix")
_stage_query("search_partial", 'apache gnu "mit license" -version', "partial")
_stage_query("search_synonym", "gnu version", "synonym", node=lambda q: Q.synonym(q, {"gnu": ("apache", "cc")}))
_stage_query("search_filtered", "license", "direct", Filters(page_range=(2, 6), block_type="paragraph"), "page_number BETWEEN 2 AND 6 AND block_type = 'paragraph'")
_stage_query("search_title", "src7 document", "direct")


def _grouped() -> None:
    query = Q.parse("the that license")
    tree = Q.partial(query)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = library(spark, sf_dir).stage(query, "partial", node=tree)
        out = S.group_and_cap(rows, per_document=2, total=25)
        return out.select(*_SHOWN, F.size("additional_matches").cast("long").alias("others"))

    QUERIES["search_grouped"] = run
    ORACLES["search_grouped"] = f"""WITH {_BLOCKS}, {_sql_stage(query, tree, "partial", 200)}, {_sql_grouped(2)}
SELECT {', '.join(_SHOWN)}, others FROM capped WHERE n <= 2 ORDER BY rank DESC, document_title, page_number, block_id LIMIT 25"""


def _sql_grouped(per_document: int) -> str:
    return """placed AS (SELECT *, row_number() OVER g AS place, count(*) OVER (PARTITION BY document_id, section_id, block_type) - 1 AS others FROM top WINDOW g AS (PARTITION BY document_id, section_id, block_type ORDER BY rank DESC, document_title, page_number, block_id)),
capped AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank DESC, document_title, page_number, block_id) AS n FROM placed WHERE place = 1)"""


_grouped()


def _first_three_words(rows: DataFrame) -> DataFrame:
    """The query set of search_many: one query of three words for each benchmark text, its first three."""
    return rows.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("text"))


@_register(
    "search_many",
    f"""WITH {_BLOCKS},
asked AS (SELECT item_id AS query_id, list_distinct({_sql_lex("array_to_string(string_split(text, ' ')[1:3], ' ')")}) AS w FROM benchmark),
words_asked AS (SELECT query_id, len(w) AS wanted, unnest(w) AS lexeme FROM asked),
flat AS (SELECT DISTINCT document_id, block_id, unnest(words) AS lexeme FROM blocks)
SELECT query_id, document_id, block_id FROM words_asked JOIN flat USING (lexeme) GROUP BY query_id, document_id, block_id HAVING count(*) = any_value(wanted)""",
)
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).search_many(_first_three_words(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


@_register(
    "search_many_whole",
    f"""WITH {_BLOCKS},
asked AS (SELECT item_id AS query_id, list_distinct({_sql_lex("text")}) AS w FROM benchmark),
words_asked AS (SELECT query_id, len(w) AS wanted, unnest(w) AS lexeme FROM asked),
flat AS (SELECT DISTINCT document_id, block_id, unnest(words) AS lexeme FROM blocks)
SELECT query_id, document_id, block_id FROM words_asked JOIN flat USING (lexeme) GROUP BY query_id, document_id, block_id HAVING count(*) = any_value(wanted)""",
)
def search_many_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of whole benchmark texts as queries."""
    return library(spark, sf_dir).search_many(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text"))


def _ladder(name: str, text: str, match_class: str, found: Q.Query, corrected: str) -> None:
    """A whole search, which ends at one stage: its best rows, grouped and capped, with the strategy. corrected: SQL of the corrected query."""
    tree = S.expression(found, match_class)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = library(spark, sf_dir).search(text, limit=10)
        return out.results.select(*_SHOWN, "match_class", "snippet", F.lit(out.strategy).alias("strategy"), F.lit(out.corrected_query).cast("string").alias("corrected_query"))

    run.__doc__ = f"The whole ladder for {text!r}, with strategy and snippets."
    QUERIES[name] = run
    # short texts are their own snippets
    ORACLES[name] = f"""WITH {_VOCABULARY.replace(_BASE, _BLOCKS, 1)}, {_sql_stage(found, tree, match_class, min(S.STAGE_CAPS[match_class], 80))}, {_sql_grouped(5)}
SELECT {', '.join(_SHOWN)}, '{match_class}' AS match_class, shown AS snippet, '{match_class}' AS strategy, {corrected} AS corrected_query
FROM capped WHERE n <= 5 ORDER BY rank DESC, document_title, page_number, block_id LIMIT 10"""


_ladder("search_ladder", "documnt src7", "partial", Q.parse("documnt src7"), "CAST(NULL AS VARCHAR)")
_ladder(
    "search_corrected", "documnt", "corrected", Q.parse("document"),
    "(SELECT term FROM (SELECT DISTINCT term FROM vocabulary WHERE left(term, 2) = 'do' AND length(term) BETWEEN 5 AND 9 ORDER BY term LIMIT 100) WHERE levenshtein(term, 'documnt') BETWEEN 1 AND 2 ORDER BY levenshtein(term, 'documnt'), term LIMIT 1)",
)


def _stemmed() -> None:
    query = Q.parse("licensing versions")
    where = "list_has_any(words, ['license', 'licensed', 'licenses', 'licensing']) AND list_has_any(words, ['version', 'versions', 'versioned', 'versioning'])"
    everything = Q.Not(Q.Words(("\x02",)))  # the forms of the two stems are the condition

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return library(spark, sf_dir).stage(query, "stemmed").select(*_SHOWN)

    QUERIES["search_stemmed"] = run
    body = _BLOCKS.replace("SELECT document_id, document_title, section_id, block_id, page_number, block_type, text, lexed FROM blocks\n  UNION ALL SELECT document_id, document_title, section_id, block_id, page_number, block_type, text, lexed FROM titles", "SELECT document_id, document_title, section_id, block_id, page_number, block_type, text, lexed, words FROM blocks")
    ORACLES["search_stemmed"] = f"WITH {body}, {_sql_stage(query, everything, 'stemmed', min(S.STAGE_CAPS['stemmed'], S.MAX_RESULTS * S.CANDIDATES_PER_RESULT), where)} SELECT {', '.join(_SHOWN)} FROM top"


_stemmed()


@_register(
    "suggest",
    f"WITH {_SUGGESTIONS}, typed AS (SELECT * FROM suggestions WHERE starts_with(normalized, 'the')), tiered AS (SELECT normalized, CASE suggestion_type WHEN 'title' THEN 0 WHEN 'heading' THEN 1 ELSE 2 END AS tier, length(text) AS size, text, suggestion_type FROM typed), best AS (SELECT normalized, min((tier, size, text, suggestion_type)) AS b FROM tiered GROUP BY normalized) SELECT b[3] AS text, b[4] AS suggestion_type FROM best ORDER BY b[1], b[2], lower(b[3]), b[3] LIMIT 10",
)
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).suggest("  The ")


_MISSPELT = ["documnt", "scr7x", "thene", "licens", "enont", "tionn", "thereon"]


@_register(
    "spelling",
    f"""WITH {_VOCABULARY}, asked AS (SELECT unnest({_MISSPELT!r}) AS term), known AS (SELECT DISTINCT term AS candidate FROM vocabulary),
unknown AS (SELECT term FROM asked WHERE length(term) >= 3 AND term NOT IN (SELECT candidate FROM known)),
pairs AS (SELECT term, candidate, row_number() OVER (PARTITION BY term ORDER BY candidate) AS n FROM unknown JOIN known ON left(term, 2) = left(candidate, 2) AND length(candidate) BETWEEN greatest(3, length(term) - 2) AND length(term) + 2),
near AS (SELECT term, candidate, levenshtein(term, candidate) AS distance FROM pairs WHERE n <= 100),
best AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY distance, candidate) AS place FROM near WHERE distance BETWEEN 1 AND 2)
SELECT term, candidate, distance, place FROM best WHERE place <= 3""",
)
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.corrections(spark.createDataFrame([(w,) for w in _MISSPELT], "term string"), library(spark, sf_dir).table("vocabulary"))


# -- documents -----------------------------------------------------------------------------------


@_register("document_list", f"WITH {_BASE}, b AS (SELECT document_id, count(*) AS blocks, max(page_number) AS pages FROM records GROUP BY document_id) SELECT document_id, title, coalesce(blocks, 0) AS blocks, coalesce(pages, 0) AS pages FROM docs LEFT JOIN b USING (document_id)")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _records(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"), F.max("page_number").alias("pages"))
    return _documents(spark, sf_dir).join(counted, "document_id", "left").select("document_id", "title", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("pages", F.lit(0)).alias("pages"))


@_register(
    "title_selection",
    rf"""WITH {_BASE}, h AS (SELECT document_id, heading FROM records WHERE ordinal = 0),
given AS (SELECT 'doc-' || doc_id AS document_id, CASE WHEN doc_id % 7 = 0 THEN '  ' || source || '  host ' END AS host, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 5 = 0 THEN 'Table of  Contents' END AS meta, source || '_' || lang || '-' || doc_id || '.pdf' AS file FROM documents),
named AS (SELECT g.*, h.heading, {_sql_collapse('host')} AS h1, {_sql_collapse('meta')} AS m1, {_sql_collapse('h.heading')} AS t1 FROM given g LEFT JOIN h USING (document_id)),
ok AS (SELECT *, length(m1) BETWEEN 3 AND 300 AND NOT regexp_matches(m1, '(?i)^table of contents$') AS m_ok, length(t1) BETWEEN 4 AND 300 AND NOT regexp_matches(t1, '(?i)^table of contents$|^by order of the\b|^for official use only\.?$') AS t_ok,
  array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(file, '\.[^./\\]+$', ''), '[_ -]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS f1 FROM named)
SELECT document_id, CASE WHEN length(h1) BETWEEN 1 AND 300 THEN h1 WHEN m_ok THEN m1 WHEN t_ok THEN t1 ELSE f1 END AS title,
  CASE WHEN length(h1) BETWEEN 1 AND 300 THEN 'host' WHEN m_ok THEN 'pdf-metadata' WHEN t_ok THEN 'first-page-heading' ELSE 'filename' END AS source FROM ok""",
)
def title_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = _records(spark, sf_dir).where("ordinal = 0").select("document_id", "heading")
    given = _rows(spark, sf_dir).select(
        F.concat(F.lit("doc-"), "doc_id").alias("document_id"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("  "), "source", F.lit("  host "))).alias("host"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 5 == 0, "Table of  Contents").alias("meta"), F.concat("source", F.lit("_"), "lang", F.lit("-"), "doc_id", F.lit(".pdf")).alias("file"),
    )
    chosen = T.select_title(F.col("host"), F.col("meta"), F.col("heading"), F.col("file"))
    return given.join(headings, "document_id", "left").select("document_id", chosen.alias("t")).select("document_id", "t.title", "t.source")


@_register(
    "document_ids",
    r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(doc_id || ' ' || source || ' ' || lang || '.PDF', '\.[^.]+$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[:72] AS b, sha256(text) AS h FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(b, '^[a-z]') THEN b ELSE 'document-' || CASE WHEN b = '' THEN 'pdf' ELSE b END END || '-' || h[:12] AS id, h AS content_sha256, 'doc-' || doc_id AS anchor, to_base64(encode(lang)) AS lang64 FROM s JOIN documents USING (doc_id)""",
)
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("text", 256)
    name = F.concat(F.col("doc_id"), F.lit(" "), "source", F.lit(" "), "lang", F.lit(".PDF"))
    return _rows(spark, sf_dir).select("doc_id", T.document_id(name, sha).alias("id"), sha.alias("content_sha256"), F.concat(F.lit("doc-"), "doc_id").alias("anchor"), F.base64(F.col("lang").cast("binary")).alias("lang64"))


@_register("delete_cascade", f"WITH {_BASE}, gone AS (SELECT 'doc-' || doc_id AS document_id FROM labels WHERE toxic = 1) SELECT r.document_id, r.block_id FROM records r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.document_id = r.document_id)")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"))
    return maintain.without(_records(spark, sf_dir), gone).select("document_id", "block_id")


@_register("retitle", f"WITH {_BASE} SELECT document_id, CASE WHEN document_id = 'doc-7' THEN 'A new title' ELSE title END AS title FROM docs")
def retitle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.retitled(_documents(spark, sf_dir), "doc-7", "A new title")


@_register(
    "reindex_changes",
    f"WITH {_BLOCKS} SELECT document_id, count(*) AS changed FROM blocks WHERE technical_variants <> CASE WHEN ordinal % 2 = 0 THEN technical_variants ELSE 'OLD-1' END GROUP BY document_id",
)
def reindex_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _blocks(spark, sf_dir).withColumn("technical_variants", F.when(F.col("ordinal") % 2 == 0, F.col("technical_variants")).otherwise("OLD-1"))
    return maintain.reindex_changes(stored).groupBy("document_id").agg(F.count(F.lit(1)).alias("changed"))


@_register(
    "import_conflicts",
    "WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT h AS content_sha256, count(*) AS copies, min(doc_id) AS first_id FROM d GROUP BY h HAVING count(*) > 1",
)
def import_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return maintain.conflicts(rows, "content_sha256", "doc_id")


@_register(
    "safe_links",
    r"SELECT page_id, len(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda h: regexp_matches(lower(trim(h)), '^(https?://|mailto:)'))) AS external, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links FROM pages".replace('\\"', '"'),
)
def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    allowed = F.filter(found, html.allowed)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.size(allowed).cast("long").alias("external"), F.size(found).cast("long").alias("links"))


def _pdf_of(heading: str, lines: list[str]) -> bytes:
    """A one-page file: a large heading, then lines close together."""
    said = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    content = b"BT /F1 20 Tf 50 700 Td (%s) Tj ET BT /F1 10 Tf 50 650 Td 12 TL " % said(heading) + b" T* ".join(b"(%s) Tj" % said(x) for x in lines) + b" ET"
    bodies = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    ]
    out, at = b"%PDF-1.4\n", []
    for i, body in enumerate(bodies, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % x for x in at)
    return out + b"xref\n0 6\n0000000000 65535 f \n%strailer\n<< /Size 6 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (table, len(out))


@_register(
    "pdf_extract",
    """WITH s AS (SELECT 'supplier-' || s_suppkey AS document_id, s_name AS h, 'nation ' || s_nationkey || ' key ' || s_suppkey AS t FROM supplier)
SELECT document_id, 'heading' AS block_type, 'h-1' AS block_id, h AS text, h AS title FROM s UNION ALL SELECT document_id, 'paragraph', 'p-1', t || ' second line', h FROM s""",
)
def pdf_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made from suppliers, read as PDF, flattened to records with a title chosen from them."""
    from scriptorium.operators import records as R
    from scriptorium.sources import pdf

    @F.pandas_udf("binary")
    def made(headings: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([_pdf_of(h, [x, "second line"]) for h, x in zip(headings, lines)])

    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    line = F.concat(F.lit("nation "), "s_nationkey", F.lit(" key "), "s_suppkey")
    files = rows.select(F.concat(F.lit("in/supplier-"), "s_suppkey", F.lit(".pdf")).alias("path"), made("s_name", line).alias("content"))
    parsed = pdf.documents(files).where("error_code is null")
    heading = F.get_json_object("semantic", "$.pages[0].blocks[0].text[0].text")
    title = T.select_title(F.lit(None).cast("string"), F.get_json_object("semantic", "$.metadata.title"), heading, F.col("original_filename"))
    named = parsed.select(F.regexp_extract("original_filename", r"^(.*)\.pdf$", 1).alias("document_id"), title["title"].alias("title"), "semantic")
    return R.split_failures(R.flatten(named))[0].select("document_id", "block_type", "block_id", "text", F.col("document_title").alias("title"))


__all__ = ["ORACLES", "QUERIES", "collapse"]
