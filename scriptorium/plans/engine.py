"""A document library: import, delete, new titles, reindex, search.

Tables: documents, semantic (the nested JSON), assets (image bytes), blocks (indexed records), postings
of lexemes, titles and stems, vocabulary and suggestions, kept by `store.Store`: every change is one
commit that is seen whole or not at all and costs what it brings. A document that cannot go in is a row
of failures; the others of its batch go in.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import html
from scriptorium.functions import query as Q
from scriptorium.functions import titles as T
from scriptorium.functions.filters import Filters
from scriptorium.operators import index, maintain
from scriptorium.operators import records as R
from scriptorium.operators import search as S
from scriptorium.plans.store import Change, Manifest, Store

DOCUMENTS = "document_id string, title string, original_filename string, content_sha256 string, page_count int, extractor_version string, created_at timestamp, updated_at timestamp"
SEMANTIC = "document_id string, semantic string"
BLOCKS = R.RECORD + ", technical_variants string, lex_simple string, lex_english string"
POSTINGS = "lexeme string, document_id string, block_id string, positions array<int>"
ASSETS = "document_id string, id string, mime_type string, width int, height int, content binary"
SCHEMAS = {
    "documents": DOCUMENTS,
    "semantic": SEMANTIC,
    "assets": ASSETS,
    "blocks": BLOCKS,
    "postings": POSTINGS,
    "title_postings": POSTINGS,
    "english_postings": POSTINGS,
    "vocabulary": "term string, document_id string",
    "suggestions": "document_id string, suggestion_type string, text string, normalized string",
}
#: What a table's files are sorted by, so that lookups skip files by their minima and maxima.
SORTED = {
    "documents": ["document_id"], "semantic": ["document_id"], "assets": ["document_id", "id"], "blocks": ["document_id", "page_number"], "postings": ["lexeme", "document_id"], "title_postings": ["lexeme", "document_id"],
    "english_postings": ["lexeme", "document_id"], "vocabulary": ["term", "document_id"], "suggestions": ["normalized", "document_id"],
}
#: What is looked up by single values that files are not sorted by.
BLOOMS = {"documents": ["title", "content_sha256"]}
#: What a title is in.
TITLED = ("documents", "title_postings", "vocabulary", "suggestions")
MAX_TITLE, MAX_FILENAME = 300, 255
#: Values of a batch that are looked up one by one.
FEW = 1000


class Conflict(ValueError):
    """A title that the library already has."""


class Invalid(ValueError):
    """Input that may not be taken; the message says why."""


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, root, SCHEMAS, SORTED, BLOOMS)

    def table(self, name: str, at: Manifest | None = None) -> DataFrame:
        return self.store.table(name, at)

    def _derived(self, records: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
        blocks = self.store.staged(index.index_blocks(records))
        return {
            "blocks": blocks, "postings": index.postings(blocks), "english_postings": index.postings(blocks, "lex_english"), "title_postings": index.title_postings(documents),
            "vocabulary": index.vocabulary(records, documents), "suggestions": index.suggestions(records, documents),
        }

    # -- import

    def ingest(self, incoming: DataFrame, replace: bool = False, extractor_version: str = "1") -> DataFrame:
        """Imports documents (semantic JSON; optionally document_id, host_title, original_filename, content_sha256, assets).

        Returns the failures (document_id, reason): those documents are left out, the others go in. A
        document whose id, title or content is taken fails; of documents of one batch that share an id
        the first by content goes in, of those that share a title or content the first by id. With
        replace, documents of the same id make way.
        """
        made, records, assets, failed = self._prepared(incoming, extractor_version)
        refused = failed

        def change(base: Manifest) -> Change | None:
            nonlocal refused
            known = self.table("documents", base).select("document_id", "title", "content_sha256")
            left, taken = made, []
            for key in ("title", "content_sha256"):
                numbered = left.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("document_id")))
                taken.append(numbered.where("place > 1").select("document_id", F.lit(f"{key} repeats in this import").alias("reason")))
                left = numbered.where("place = 1").drop("place")
            left = self.store.staged(left)
            for key in ("title", "content_sha256") if replace else ("document_id", "title", "content_sha256"):
                theirs = self._matching(known, key, left).select(F.col(key).alias("value"), F.col("document_id").alias("owner"))
                other = F.col(key) == F.col("value")
                if replace:  # a document's own older version makes way
                    other &= F.col("document_id") != F.col("owner")
                taken.append(left.join(theirs, other, "left_semi").select("document_id", F.lit(f"{key} is taken").alias("reason")))
            out = self.store.staged(reduce(DataFrame.unionByName, taken).groupBy("document_id").agg(F.min("reason").alias("reason")))
            refused = self.store.report(failed.unionByName(out))
            documents = self.store.staged(maintain.without(left, out))
            if documents.isEmpty():
                return None
            own = documents.select("document_id")
            parts = {"documents": documents, "semantic": documents, "assets": assets.join(own, "document_id", "left_semi"), **self._derived(records.join(own, "document_id", "left_semi"), documents)}
            gone = self.store.staged(self._matching(known, "document_id", documents).select("document_id")) if replace else None
            return Change(parts, None if gone is None or gone.isEmpty() else gone)

        self.store.commit(change)
        return refused

    def _matching(self, rows: DataFrame, key: str, batch: DataFrame) -> DataFrame:
        """Rows whose key the batch has: looked up value by value if these are few, so that files can be skipped."""
        values = [r[0] for r in batch.select(key).distinct().limit(FEW + 1).collect()]  # at most FEW + 1
        if len(values) <= FEW:
            return rows.where(F.col(key).isin(values)) if values else rows.limit(0)
        return rows.join(batch.select(key).distinct(), key, "left_semi")

    def _prepared(self, incoming: DataFrame, extractor_version: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Documents with their titles, their records and assets, and the failures that need no look at the library."""
        have = set(incoming.columns)
        col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
        meta = F.from_json("semantic", "metadata struct<id: string, title: string, displayTitle: string, pageCount: int>, pages array<struct<pageNumber: int, blocks: array<struct<type: string, level: int, text: array<struct<text: string>>>>>>")
        rows = incoming.withColumn("m", meta)
        front = F.get(F.filter("m.pages", lambda p: p["pageNumber"] == 1), F.lit(0))
        first = F.get(F.filter(front["blocks"], lambda b: (b["type"] == "heading") & (b["level"] == 1)), F.lit(0))
        heading = F.array_join(F.transform(first["text"], lambda r: r["text"]), "")
        name = F.coalesce(col("original_filename"), F.lit("document.pdf"))
        sha = F.coalesce(col("content_sha256"), F.sha2(F.col("semantic"), 256))
        rows = rows.withColumns({"content_sha256": sha, "original_filename": name, "heading": heading, "page_count": F.coalesce("m.metadata.pageCount", F.size("m.pages"))})
        rows = rows.withColumn("document_id", F.coalesce(col("document_id"), F.col("m.metadata.id"), T.document_id(F.col("original_filename"), F.col("content_sha256"))))
        chosen = T.select_title(col("host_title"), F.col("m.metadata.title"), F.col("heading"), F.col("original_filename"))
        now = F.current_timestamp()
        assets = F.col("assets") if "assets" in have else F.lit(None).cast("array<struct<id: string, mime_type: string, width: int, height: int, content: binary>>")
        made = rows.withColumn("title", chosen["title"]).withColumns({"extractor_version": F.lit(extractor_version), "created_at": now, "updated_at": now, "assets": assets})
        made = made.withColumn("semantic", R.with_title(F.col("semantic"), F.col("title")))
        place = F.row_number().over(Window.partitionBy("document_id").orderBy("content_sha256", "title"))
        made = self.store.staged(made.select(*[c.split()[0] for c in DOCUMENTS.split(", ")], "semantic", "assets", F.col("m").isNull().alias("broken")).withColumn("place", place))
        repeated = made.where("place > 1").select("document_id", F.lit("document_id repeats in this import").alias("reason"))
        made = made.where("place = 1").drop("place")
        flat = self.store.staged(R.flatten(made))
        records, failures = R.split_failures(flat)
        pictures = made.select("document_id", F.explode("assets").alias("a")).select("document_id", "a.*")
        bad_input = made.where(~T.is_safe_id(F.col("document_id")) | (F.length("title") > MAX_TITLE) | (F.length("original_filename") > MAX_FILENAME) | F.col("broken")).select("document_id", F.lit("invalid id, title, file name or JSON").alias("reason"))
        bad_asset = pictures.where(~T.is_safe_asset(F.col("id"))).select("document_id", F.lit("invalid asset name").alias("reason"))
        invalid = R.validate(records, R.known_blocks(made)).select("document_id", "reason")
        bad = self.store.staged(reduce(DataFrame.unionByName, [failures, bad_input, bad_asset, invalid]).groupBy("document_id").agg(F.min("reason").alias("reason")))
        keep = lambda df: maintain.without(df, bad)
        return self.store.staged(keep(made).drop("assets", "broken")), self.store.staged(keep(records)), self.store.staged(keep(pictures)), self.store.staged(bad.unionByName(repeated))

    def put_records(self, documents: DataFrame, records: DataFrame) -> int:
        """Adds documents (DOCUMENTS' columns) that are search records already; nothing is validated."""
        names = [c.split()[0] for c in DOCUMENTS.split(", ")]
        documents = self.store.staged(documents.select(*names))
        parts = {"documents": documents, **self._derived(self.store.staged(records.select(*[c.split()[0] for c in R.RECORD.split(", ")])), documents)}
        return self.store.commit(lambda base: Change(parts))

    # -- documents

    def documents(self) -> DataFrame:
        """Newest first."""
        return self.table("documents").orderBy(F.col("created_at").desc(), "document_id")

    def load(self, document_id: str) -> DataFrame:
        """The document's row with its semantic JSON and assets; no row if there is none."""
        one = F.col("document_id") == document_id
        pictures = self.table("assets").where(one).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("id", "mime_type", "width", "height", "content"))).alias("assets"))
        return self.table("documents").where(one).join(self.table("semantic").where(one), "document_id").join(pictures, "document_id", "left")

    def html(self, document_id: str) -> str | None:
        """The document as HTML, its images as data URIs; None if there is none."""
        row = self.load(document_id).first()
        return None if row is None else html.render(json.loads(row.semantic), {a.id: html.data_uri(a.mime_type, a.content) for a in row.assets or []})

    def pages(self) -> DataFrame:
        """document_id, html of all documents, without image bytes."""
        return self.table("semantic").select("document_id", html.rendered(F.col("semantic")).alias("html"))

    def delete(self, document_ids: list[str] | DataFrame) -> int:
        """Removes documents and all that was derived from them; how many there were."""
        wanted = document_ids if isinstance(document_ids, DataFrame) else self.spark.createDataFrame([(i,) for i in document_ids], "document_id string")
        n = 0

        def change(base: Manifest) -> Change | None:
            nonlocal n
            there = self._matching(self.table("documents", base), "document_id", wanted).select("document_id")
            n = there.count()
            return Change(gone=there) if n else None

        self.store.commit(change)
        return n

    def retitle(self, document_id: str, title: str) -> bool:
        """A new title, with the words and suggestions that come from it; False if there is no such document."""
        title = " ".join(title.split())
        if not 1 <= len(title) <= MAX_TITLE:
            raise Invalid("Invalid document title.")
        one = F.col("document_id") == document_id
        found = True

        def change(base: Manifest) -> Change | None:
            nonlocal found
            documents = self.table("documents", base)
            mine = documents.where(one)
            found = not mine.isEmpty()
            if not found:
                return None
            if not documents.where((F.col("title") == title) & ~one).isEmpty():
                raise Conflict(f"title is taken: {title}")
            mine = self.store.staged(maintain.retitled(mine, document_id, title).withColumn("updated_at", F.current_timestamp()))
            record = self.table("blocks", base).where(one)
            parts = {"documents": mine, "title_postings": index.title_postings(mine), "vocabulary": index.vocabulary(record, mine), "suggestions": index.suggestions(record, mine)}
            return Change(parts, mine.select("document_id"), TITLED)

        self.store.commit(change)
        return found

    def stage_title(self, document_id: str, title: str) -> None:
        """Keeps a title aside until publish_title or discard_title; a second one takes the first one's place."""
        if not T.safe_id(document_id) or not 1 <= len(" ".join(title.split())) <= MAX_TITLE:
            raise Invalid("Invalid document id or title.")
        self.store.write_text(json.dumps({"title": title}), "staged_titles", f"{document_id}.json")

    def publish_title(self, document_id: str) -> bool:
        """Makes the staged title the document's; False if there is none, or no such document."""
        text = self.store.read_text("staged_titles", f"{document_id}.json") if T.safe_id(document_id) else None
        if text is None or not self.retitle(document_id, json.loads(text)["title"]):
            return False
        self.discard_title(document_id)
        return True

    def discard_title(self, document_id: str) -> None:
        if T.safe_id(document_id):
            self.store.remove("staged_titles", f"{document_id}.json")

    def reindex(self, document_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Builds what is derived again from the stored records, of some documents or all, in one job.

        Returns what had changed (document_id, block_id, technical_variants, now) and the failures
        (document_id, reason): documents with stored records that may not be; they stay as they are.
        """
        names = [c.split()[0] for c in R.RECORD.split(", ")]
        out: tuple[DataFrame, DataFrame] | None = None
        derived = tuple(n for n in SCHEMAS if n not in ("documents", "semantic", "assets"))

        def change(base: Manifest) -> Change:
            nonlocal out
            only = F.col("document_id").isin(document_ids) if document_ids is not None else F.lit(True)
            blocks, documents = self.table("blocks", base).where(only), self.table("documents", base).where(only)
            records = blocks.select(*names)
            failed = self.store.staged(R.validate(records, None).groupBy("document_id").agg(F.min("reason").alias("reason")))
            good = documents.join(failed, "document_id", "left_anti")
            changed = maintain.reindex_changes(maintain.without(blocks, failed)).select("document_id", "block_id", "technical_variants", F.col("fresh").alias("now"))
            out = self.store.report(changed), self.store.report(failed)
            return Change(self._derived(self.store.staged(maintain.without(records, failed)), good), self.store.staged(good.select("document_id")), derived)

        self.store.commit(change)
        if document_ids is None:
            self.store.compact()
        return out

    def sizes(self) -> DataFrame:
        """Rows, distinct keys and bytes of each table, and of all."""
        at = self.store.manifest()
        parts = []
        for n in SCHEMAS:
            held = sum(self.store.bytes_of(n, f"at_version={v}", f"segment={s}") for v, s in at.tables.get(n, []))
            parts.append(self.table(n, at).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.countDistinct(SORTED[n][0]).alias("keys"), F.lit(held).cast("long").alias("bytes")))
        return reduce(DataFrame.unionByName, parts)

    # -- search

    def lookup(self, at: Manifest | None = None) -> S.Lookup:
        at = at or self.store.manifest()
        return S.Lookup(self.table("postings", at).unionByName(self.table("title_postings", at)), self.table("english_postings", at))

    def search(self, text: str, limit: int = 20, per_document: int = S.PER_DOCUMENT, filters: Filters = Filters()) -> S.Response:
        at = self.store.manifest()
        return S.search(self.table("blocks", at), self.table("documents", at), self.table("vocabulary", at), text, limit, per_document, filters, self.lookup(at))

    def stage(self, query: Q.Query, match_class: str, filters: Filters = Filters(), limit: int = S.MAX_RESULTS, node=None) -> DataFrame | None:
        at = self.store.manifest()
        return S.stage(self.table("blocks", at), self.table("documents", at), query, match_class, filters, limit, node, self.lookup(at))

    def search_many(self, queries: DataFrame) -> DataFrame:
        return S.search_many(queries, self.table("postings"))

    def suggest(self, typed: str) -> DataFrame:
        return S.suggest(self.table("suggestions"), typed)

    def explain(self, text: str, match_class: str = "direct", filters: Filters = Filters()) -> str:
        """The plans of a stage: of its lookups in the postings, then of reading what they name."""
        query = Q.parse(text)
        node = S.expression(query, match_class)
        if node is None:
            return ""
        at = self.store.manifest()
        lookup = self.lookup(at)
        lookups, _ = S.looked_up(lookup.english if match_class == "stemmed" else lookup.simple, node, filters)
        return "\n".join(S.explain(df) for df in [*lookups, S.stage(self.table("blocks", at), self.table("documents", at), query, match_class, filters, lookup=lookup)])

    def explain_suggest(self, typed: str) -> str:
        return S.explain(self.suggest(typed))
