"""What is derived from search records: indexed blocks, postings, vocabulary, suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import identifiers as I
from scriptorium.functions import lexemes as L
from scriptorium.functions.stemming import stemmed

#: Bounds of vocabulary terms and suggestions.
TERM_LENGTHS, TERMS_PER_DOCUMENT = (3, 40), 200
SUGGESTIONS_PER_DOCUMENT, SUGGESTION_LENGTH = 60, 200
SUGGESTION_TIERS = {"title": 0, "heading": 1, "technical": 2}
_WORDS = "[a-z0-9]+(?:-[a-z0-9]+)*"
_FIELDS = ("heading", "table_header", "row_header", "text")


def index_blocks(records: DataFrame, english: bool = True) -> DataFrame:
    """Records with technical_variants and joined lexemes, simple and (unless left out) stemmed.

    Lexemes go field by field: heading, table header, row header, text, and simple ones then variants.
    """
    out = records.withColumn("technical_variants", I.variants(*map(F.col, _FIELDS)))
    out = out.withColumn("lex_simple", L.join(*[L.lexemes(F.col(c)) for c in (*_FIELDS, "technical_variants")]))
    if english:
        words = F.concat(*[F.coalesce(L.lexemes(F.col(c)), F.array().cast("array<string>")) for c in _FIELDS])
        out = out.withColumn("lex_english", L.join(stemmed(words)))
    return out


def postings(blocks: DataFrame, lexed: str = "lex_simple") -> DataFrame:
    """lexeme, document_id, block_id, positions: the inverted index; written sorted by lexeme, a term is a range.

    The one shuffle deals out whole blocks; their positions are grouped where they are made.
    """
    dealt = blocks.select("document_id", "block_id", F.col(lexed).alias("lexed")).repartition("document_id", "block_id")
    words = F.array_remove(F.split("lexed", L.MARK), "")
    flat = dealt.select("document_id", "block_id", F.posexplode(words).alias("position", "lexeme"))
    return flat.groupBy("lexeme", "document_id", "block_id").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def title_postings(documents: DataFrame) -> DataFrame:
    """The same of titles; their block_id is null."""
    titles = documents.select("document_id", F.lit(None).cast("string").alias("block_id"), L.join(L.lexemes(F.col("title"))).alias("lex_simple"))
    return postings(titles)


def first_kept(rows: DataFrame, keys: list[str], order: list[str], cap: int, within: list[str]) -> DataFrame:
    """Of equal keys the first in order; of these the first `cap` within each group.

    Partial aggregation drops repeats before any shuffle, so a group's window holds distinct keys only.
    """
    others = [c for c in rows.columns if c not in (*keys, *within, *order)]
    firsts = rows.groupBy(*within, *keys).agg(F.min(F.struct(*order, *others)).alias("first")).select(*within, *keys, "first.*")
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return firsts.withColumn("place", place).where(F.col("place") <= cap).drop("place")


def _ordinal(records: DataFrame) -> Column:
    return F.col("ordinal") if "ordinal" in records.columns else F.lit(0)


def vocabulary(records: DataFrame, documents: DataFrame) -> DataFrame:
    """term, document_id: words of titles, headings and table headers, and identifiers of texts.

    documents: document_id, title. Order, for the cap of a document: title, then record by record.
    """
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(_WORDS), F.lit(0))
    titles = documents.select("document_id", F.lit(-1).alias("record"), F.posexplode(words(F.col("title"))).alias("place", "term"))
    named = F.transform(I.identifiers(F.col("text")), lambda x: F.lower(x))
    parts = F.concat(words(F.col("heading")), words(F.col("table_header")), words(F.col("row_header")), named)
    rest = records.select("document_id", _ordinal(records).alias("record"), F.posexplode(parts).alias("place", "term"))
    good = titles.unionByName(rest).where(F.length("term").between(*TERM_LENGTHS))
    return first_kept(good, ["term"], ["record", "place"], TERMS_PER_DOCUMENT, ["document_id"]).select("term", "document_id")


def normalise(text: Column) -> Column:
    """Suggestion text as it is compared: lower case, white space collapsed."""
    return L.collapse(F.lower(text))


def suggestions(records: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, suggestion_type, text, normalized: titles, then headings, then identifiers."""
    titles = documents.select("document_id", F.lit(0).alias("stage"), F.lit(0).alias("record"), F.lit(0).alias("place"), F.lit("title").alias("suggestion_type"), F.col("title").alias("text"))
    record = _ordinal(records).alias("record")
    headings = records.where("block_type = 'heading'").select("document_id", F.lit(1).alias("stage"), record, F.lit(0).alias("place"), F.lit("heading").alias("suggestion_type"), F.col("heading").alias("text"))
    found = reduce(lambda a, b: F.concat(a, b), [I.identifiers(F.col(c)) for c in _FIELDS])
    technical = records.select("document_id", F.lit(2).alias("stage"), record, F.posexplode(found).alias("place", "name")).select(
        "document_id", "stage", "record", "place", F.lit("technical").alias("suggestion_type"), I.hyphenated(F.col("name")).alias("text")
    )
    rows = titles.unionByName(headings).unionByName(technical).withColumn("text", L.collapse(F.col("text")))
    rows = rows.where(F.length("text").between(1, SUGGESTION_LENGTH)).withColumn("normalized", normalise(F.col("text")))
    kept = first_kept(rows, ["suggestion_type", "normalized"], ["stage", "record", "place"], SUGGESTIONS_PER_DOCUMENT, ["document_id"])
    return kept.select("document_id", "suggestion_type", "text", "normalized")
