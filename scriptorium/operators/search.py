"""Search stages, the ladder over them, grouping and caps, autocomplete and spelling."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import lexemes as L
from scriptorium.functions import query as Q
from scriptorium.functions.filters import Filters
from scriptorium.functions.ranking import STRATEGIES, TIERS, score_components
from scriptorium.functions.snippets import snippet_column
from scriptorium.functions.stemming import lex_english
from scriptorium.operators.index import SUGGESTION_TIERS, TERM_LENGTHS, normalise

#: Candidates a stage may bring, results, and when broadening stops.
STAGE_CAPS = {"direct": 400, "prefix": 150, "stemmed": 150, "synonym": 150, "partial": 200, "corrected": 200}
CANDIDATES_PER_RESULT = 8
MAX_RESULTS, PER_DOCUMENT, MAX_PER_DOCUMENT = 50, 5, 20
USEFUL_RESULTS = 3
#: Bounds of spelling corrections and suggestions.
MAX_DISTANCE, MAX_LENGTH_DELTA, MIN_CORRECTABLE = 2, 2, 3
MAX_EXAMINED, MAX_CORRECTIONS, MAX_CORRECTED_TERMS = 100, 3, 3
SUGGESTION_PREFIX, MAX_SUGGESTIONS = (2, 100), 10
#: Queries of a batch whose words may be broadcast: at most 24 each.
MANY = 10_000


def by_name(column: str) -> Column:
    """Titles and ids in Unicode order, not byte order."""
    return F.collate(F.col(column), "UNICODE")


def title_rows(documents: DataFrame) -> DataFrame:
    """Documents as rows that a search can find by title."""
    return documents.select(
        "document_id", F.col("title").alias("document_title"), F.col("document_id").alias("block_id"), F.col("document_id").alias("section_id"), F.col("title").alias("heading"),
        F.array().cast("array<string>").alias("heading_path"), F.lit(1).alias("page_number"), F.lit("document-title").alias("block_type"), F.col("title").alias("text"),
        L.join(L.lexemes(F.col("title"))).alias("lexed"),
    )


def matches(blocks: DataFrame, documents: DataFrame, node, filters: Filters = Filters(), lexed: str = "lex_simple", titles: bool = True) -> DataFrame:
    """Rows that an expression matches: blocks, with their documents' present titles, and titles."""
    hit = blocks.where(filters.condition()).where(Q.condition(node, F.col(lexed)))
    hit = hit.select("document_id", "block_id", "section_id", "heading", "heading_path", "page_number", "block_type", "text")
    hit = hit.join(documents.select("document_id", F.col("title").alias("document_title")), "document_id")
    if titles:
        named = title_rows(documents).where(filters.condition()).where(Q.condition(node, F.col("lexed"))).drop("lexed")
        hit = hit.unionByName(named)
    return hit


def scored(rows: DataFrame, query: Q.Query, match_class: str) -> DataFrame:
    parts = score_components(F.col("block_type"), F.col("text"), query.terms, query.phrases, match_class)
    return rows.withColumn("score_components", parts).withColumns({"rank": F.col("score_components.final_score"), "match_class": F.lit(match_class), "tier": F.lit(TIERS.index(match_class))})


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*result_order())


def result_order() -> list[Column]:
    """Stricter class, higher score, title, page, block."""
    return [F.col("tier"), F.col("rank").desc(), by_name("document_title"), F.col("page_number"), by_name("block_id")]


@dataclass
class Lookup:
    """Stored postings (lexeme, document_id, block_id), sorted by lexeme: of simple lexemes and titles, and of stems."""

    simple: DataFrame
    english: DataFrame


#: Documents that postings may name for a stage to fetch only these; beyond, it scans.
FETCH = 1000


def _any(leaves) -> Column:
    exact = sorted(w for w, prefix in leaves if not prefix)
    parts = ([F.col("lexeme").isin(exact)] if exact else []) + [F.startswith("lexeme", F.lit(w)) for w, prefix in sorted(leaves) if prefix]
    return reduce(lambda a, b: a | b, parts)


def looked_up(postings: DataFrame, node, filters: Filters = Filters()) -> tuple[list[DataFrame], list[str] | None]:
    """The lookups made, and the documents that can match; None if they are too many to fetch one by one.

    Every match holds a lexeme of the expression's cheapest cover: of a conjunction the rarest part,
    of alternatives one of each. Counts and ids come from scans of the lexemes' ranges alone.
    """
    leaves = Q.leaves(node)
    if not leaves:
        return [], None
    mine = postings.where(F.col("document_id") == filters.document_id) if filters.document_id else postings
    ordered_leaves = sorted(leaves)
    counted = mine.where(_any(leaves)).agg(*[F.count(F.when(_any([leaf]), 1)).alias(f"n{i}") for i, leaf in enumerate(ordered_leaves)])
    counts = dict(zip(ordered_leaves, counted.first()))
    found = Q.cover(node, counts)
    if found is None:
        return [counted], None
    wanted = [leaf for leaf in found[1] if counts[leaf]]
    if not wanted:
        return [counted], []
    ids = mine.where(_any(wanted)).select("document_id").distinct().limit(FETCH + 1)
    got = [r.document_id for r in ids.collect()]  # at most FETCH + 1
    return [counted, ids], sorted(got) if len(got) <= FETCH else None


def expression(query: Q.Query, match_class: str):
    """What a stage looks for; None where it does not apply to the query."""
    if match_class == "stemmed":
        return Q.strict(query, lex_english)
    return {"direct": Q.strict, "prefix": Q.prefix, "synonym": Q.synonym, "partial": Q.partial, "corrected": Q.strict}[match_class](query)


def stage(blocks: DataFrame, documents: DataFrame, query: Q.Query, match_class: str, filters: Filters = Filters(), limit: int = MAX_RESULTS, node=None, lookup: Lookup | None = None) -> DataFrame | None:
    """One stage's candidates, best first; None where the stage does not apply to the query.

    With stored postings only the documents that they name are read; where these are more than FETCH,
    or without postings, blocks are scanned with the whole expression as a filter, without a shuffle.
    """
    english = match_class == "stemmed"
    node = node or expression(query, match_class)
    if node is None:
        return None
    if lookup is not None:
        _, ids = looked_up(lookup.english if english else lookup.simple, node, filters)
        if ids is not None:
            only = F.col("document_id").isin(ids) if ids else F.lit(False)
            blocks, documents = blocks.where(only), documents.where(only)
    rows = matches(blocks, documents, node, filters, "lex_english" if english else "lex_simple", titles=not english)
    return ordered(scored(rows, query, match_class)).limit(min(STAGE_CAPS[match_class], limit * CANDIDATES_PER_RESULT))


def group_and_cap(candidates: DataFrame, per_document: int = PER_DOCUMENT, total: int = MAX_RESULTS) -> DataFrame:
    """One row for each (document, section, block type): its best candidate, the others in additional_matches.

    Then at most per_document rows of a document and total rows in all, best first.
    """
    group = ["document_id", "section_id", "block_type"]
    best = Window.partitionBy(*group).orderBy(*result_order())
    other = F.struct("place", "block_id", "page_number", "text", F.col("rank"), "match_class")
    ranked = candidates.withColumn("place", F.row_number().over(best))
    rest = F.sort_array(F.collect_list(F.when(F.col("place") > 1, other)).over(Window.partitionBy(*group)))
    first = ranked.withColumn("additional_matches", rest).where("place = 1").drop("place")
    capped = Window.partitionBy("document_id").orderBy(*result_order())
    kept = first.withColumn("place", F.row_number().over(capped)).where(F.col("place") <= per_document).drop("place")
    return ordered(kept).limit(total)


def with_snippets(results: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Results with snippet and matches: only rows that are shown get one."""
    return results.withColumn("shown", snippet_column(F.col("text"), terms)).select("*", "shown.*").drop("shown")


@dataclass
class Response:
    results: DataFrame
    strategy: str
    stages: list[str] = field(default_factory=list)
    corrected_query: str | None = None
    corrections: list[dict] = field(default_factory=list)
    expansions: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)


def search(blocks: DataFrame, documents: DataFrame, vocabulary: DataFrame, text: str, limit: int = 20, per_document: int = PER_DOCUMENT, filters: Filters = Filters(), lookup: Lookup | None = None) -> Response:
    """The ladder: stages from strict to loose until there are enough results.

    Each stage is one bounded top-k; its candidates (at most 400 rows) are kept on the driver, so a
    later stage never runs an earlier one again. A block counts for the strictest stage that found it.
    """
    spark: SparkSession = blocks.sparkSession
    text = " ".join(text.split())
    limit, per_document = min(max(int(limit), 1), MAX_RESULTS), min(max(int(per_document), 1), MAX_PER_DOCUMENT)
    found: dict[tuple[str, str], object] = {}
    out = Response(None, "strict")  # type: ignore[arg-type]
    form = None

    def add(rows: DataFrame | None) -> None:
        nonlocal form
        if rows is not None:
            form = form or rows.schema
            for r in rows.collect():  # at most STAGE_CAPS rows
                found.setdefault((r.document_id, r.block_id), r)

    def results() -> DataFrame:
        return group_and_cap(spark.createDataFrame(list(found.values()), form), per_document, limit)

    def shown() -> int:
        """How many rows results() has."""
        groups = Counter(d for d, _, _ in {(r.document_id, r.section_id, r.block_type) for r in found.values()})
        return min(limit, sum(min(per_document, n) for n in groups.values()))

    if not text:
        form = scored(title_rows(documents).drop("lexed"), Q.Query("", (), (), (), False, (), False), "direct").schema
        out.results = with_snippets(results(), ())
        return out
    query = Q.parse(text)
    terms = query.terms
    for match_class in TIERS:
        if match_class == "corrected":
            fixed = correct_query(vocabulary, query)
            if fixed is None:
                continue
            query, out.corrections = fixed
            out.corrected_query = query.normalized
        rows = stage(blocks, documents, query, match_class, filters, limit, lookup=lookup)
        if rows is None:
            continue
        out.stages.append(match_class)
        if match_class == "synonym":
            out.expansions = [e for e in Q.expansions(query) if e[1]]
        add(rows)
        if shown() >= min(USEFUL_RESULTS, limit):
            break
    final = results()
    loosest = final.agg(F.max("tier")).first()[0]
    out.strategy = STRATEGIES[TIERS[loosest or 0]]
    if loosest != TIERS.index("corrected"):
        out.corrected_query, out.corrections = None, []
    out.results = with_snippets(final, tuple(dict.fromkeys((*terms, *query.terms))))
    return out


# -- spelling ------------------------------------------------------------------------------------


def has_term(vocabulary: DataFrame, term: str) -> bool:
    return not vocabulary.where(F.col("term") == term).limit(1).isEmpty()


def corrections(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, candidate, distance, place: up to three corrections of each of many unknown terms.

    Candidates share the first two characters and nearly the length; the first 100 in order are looked
    at. The prefix is an equi-join key, so no pair of different prefixes is ever made.
    """
    known = vocabulary.select("term").distinct()
    unknown = terms.select("term").where(F.length("term") >= MIN_CORRECTABLE).distinct().join(known, "term", "left_anti")
    left = unknown.withColumn("start", F.substring("term", 1, 2))
    right = known.select(F.col("term").alias("candidate"), F.substring("term", 1, 2).alias("start"), F.length("term").alias("size"))
    # of one start and length only the first can be looked at: a common start brings a bounded number of pairs
    first = F.row_number().over(Window.partitionBy("start", "size").orderBy("candidate"))
    right = right.withColumn("n", first).where(F.col("n") <= MAX_EXAMINED).drop("n", "size")
    span = F.length("candidate").between(F.greatest(F.lit(TERM_LENGTHS[0]), F.length("term") - MAX_LENGTH_DELTA), F.length("term") + MAX_LENGTH_DELTA)
    pairs = left.join(right, (left["start"] == right["start"]) & span).select("term", "candidate")
    examined = pairs.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("candidate"))).where(F.col("n") <= MAX_EXAMINED)
    near = examined.withColumn("distance", F.levenshtein("term", "candidate", MAX_DISTANCE)).where("distance > 0")
    place = F.row_number().over(Window.partitionBy("term").orderBy("distance", by_name("candidate")))
    return near.withColumn("place", place).where(F.col("place") <= MAX_CORRECTIONS).select("term", "candidate", "distance", "place")


def correct_query(vocabulary: DataFrame, query: Q.Query) -> tuple[Q.Query, list[dict]] | None:
    """The query with its unknown words replaced by the best known ones, and what was replaced."""
    if query.has_or:
        return None
    words = [c.words[0] for c in query.clauses if not c.quoted and len(c.words[0]) >= MIN_CORRECTABLE][:MAX_CORRECTED_TERMS]
    if not words:
        return None
    spark = vocabulary.sparkSession
    found: dict[str, list] = {}
    for r in corrections(spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "term string"), vocabulary).orderBy("term", "place").collect():
        found.setdefault(r.term, []).append(r)
    if not found:
        return None
    best = {t: rows[0].candidate for t, rows in found.items()}
    said = [f'"{" ".join(c.words)}"' if c.quoted else best.get(c.words[0], c.words[0]) for c in query.clauses] + [f"-{w}" for w in query.excluded]
    try:
        fixed = Q.parse(" ".join(said))
    except Q.QueryError:
        return None
    return fixed, [{"original": t, "corrected": r[0].candidate, "distance": r[0].distance, "alternatives": [x.candidate for x in r[1:]]} for t, r in found.items()]


# -- autocomplete --------------------------------------------------------------------------------


def rank_suggestions(rows: DataFrame, total: int = MAX_SUGGESTIONS) -> DataFrame:
    """text, suggestion_type: of equal texts the strictest type; then type, length, text."""
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in SUGGESTION_TIERS.items() for x in kv]), F.col("suggestion_type"))
    best = rows.withColumn("tier", tier).groupBy("normalized").agg(F.min(F.struct("tier", F.length("text").alias("size"), "text", "suggestion_type")).alias("s")).select("s.*")
    return best.orderBy("tier", "size", by_name("text")).limit(total).select("text", "suggestion_type")


def suggest(suggestions: DataFrame, raw: str) -> DataFrame:
    """Suggestions for what has been typed; none for fewer than two or more than a hundred characters."""
    typed = " ".join(raw.lower().split())
    low, high = SUGGESTION_PREFIX
    if not low <= len(typed) <= high:
        return suggestions.limit(0).select("text", "suggestion_type")
    return rank_suggestions(suggestions.where(F.startswith("normalized", F.lit(typed))))


def search_many(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, document_id, block_id: strict matches of many queries of plain words at once.

    queries: query_id, text. Each query's rarest lexeme names its candidates; they then meet the
    postings of its other lexemes by lexeme, document and block, so a common word costs no more than
    the candidates that are asked about it. Titles are not searched.
    """
    words = queries.select("query_id", F.array_distinct(L.lexemes(F.col("text"))).alias("words")).where(F.size("words") > 0)
    asked = words.select("query_id", F.size("words").alias("wanted"), F.explode("words").alias("lexeme"))
    held = postings.where("block_id is not null").select("lexeme", "document_id", "block_id")
    needed = asked.select("lexeme").distinct()
    few = lambda df: F.broadcast(df) if few_queries else df
    few_queries = queries.limit(MANY + 1).count() <= MANY
    counts = held.join(few(needed), "lexeme").groupBy("lexeme").agg(F.count(F.lit(1)).alias("n"))
    known = asked.join(counts, "lexeme")
    # a query with an unknown word has no match
    rarest = known.groupBy("query_id").agg(F.min(F.struct("n", "lexeme")).alias("r"), F.max("wanted").alias("wanted"), F.count(F.lit(1)).alias("found")).where("found = wanted")
    rarest = rarest.select("query_id", "wanted", F.col("r.lexeme").alias("lexeme"))
    candidates = held.join(few(rarest), "lexeme").select("query_id", "wanted", "document_id", "block_id", F.col("lexeme").alias("rarest"))
    alone = candidates.where("wanted = 1").select("query_id", "document_id", "block_id")
    rest = candidates.where("wanted > 1").join(few(asked.select("query_id", "lexeme")), "query_id").where("lexeme <> rarest")
    hits = rest.join(held, ["lexeme", "document_id", "block_id"]).groupBy("query_id", "document_id", "block_id").agg(F.count(F.lit(1)).alias("n"), F.first("wanted").alias("wanted"))
    return hits.where("n = wanted - 1").select("query_id", "document_id", "block_id").unionByName(alone)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


__all__ = ["Lookup", "Response", "corrections", "correct_query", "explain", "group_and_cap", "has_term", "matches", "normalise", "rank_suggestions", "scored", "search", "search_many", "stage", "suggest", "with_snippets"]
