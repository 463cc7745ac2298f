"""Nested documents to flat search records, and walks over their trees.

A document is JSON text: metadata, pages of blocks (heading, paragraph, list, table, figure), outline
and assets. Lists and table cells hold blocks again, which no Spark type can say, so a document is
flattened in Python, one at a time, in batches; everything after that is columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE_ID = re.compile(r"[a-z][a-z0-9-]*")
RECORD = (
    "document_id string, document_title string, section_id string, block_id string, heading string, heading_path array<string>, "
    "page_number int, block_type string, text string, table_header string, row_header string, ordinal int"
)
#: Block types of records, beside the title rows of search results.
BLOCK_TYPES = ("heading", "paragraph", "list-item", "table-cell", "figure-caption")


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _runs(runs: list | None) -> str:
    return _squeeze("".join(r.get("text", "") for r in runs or []))


def block_text(block: dict) -> str:
    """All text of a block and of the blocks in it."""
    kind = block.get("type")
    if kind in ("heading", "paragraph"):
        return _runs(block.get("text"))
    if kind == "figure":
        return _runs(block.get("caption"))
    inner = []
    if kind == "list":
        inner = [b for item in block.get("items", []) for b in item.get("blocks", [])]
    elif kind == "table":
        inner = [b for row in block.get("rows", []) for cell in row.get("cells", []) for b in cell.get("blocks", [])]
    return _squeeze(" ".join(map(block_text, inner)))


def _blocks_text(blocks: list) -> str:
    return _squeeze(" ".join(map(block_text, blocks)))


def _safe(value: str, what: str) -> str:
    if not SAFE_ID.fullmatch(value):
        raise ValueError(f"Invalid {what}: {value}")
    return value


def records(document: dict, document_id: str | None = None, title: str | None = None) -> Iterator[dict]:
    """The search records of one document, in reading order; empty texts make none.

    The open headings carry over from page to page; a block outside any section belongs to page-N.
    """
    meta = document.get("metadata") or {}
    document_id = document_id or meta.get("id")
    if not document_id:
        raise ValueError("A document id is required to generate search records.")
    _safe(document_id, "document id")
    title = title if title is not None else meta.get("displayTitle") or meta.get("title") or "Untitled document"
    open_headings: list[tuple[int, str, str]] = []  # level, text, section

    def record(block_id: str, kind: str, text: str, page: int, section: str, table_header: str = "", row_header: str = "") -> Iterator[dict]:
        if text:
            path = [t for _, t, _ in open_headings if t]
            yield {
                "document_id": document_id, "document_title": title, "section_id": _safe(section, "section id"), "block_id": _safe(block_id, "block id"),
                "heading": path[-1] if path else "", "heading_path": path, "page_number": page, "block_type": kind, "text": text,
                "table_header": table_header or None, "row_header": row_header or None,
            }

    def visit(block: dict, outside: str) -> Iterator[dict]:
        kind, page = block.get("type"), block.get("pageNumber")
        if kind == "heading":
            text, level, section = _runs(block.get("text")), block["level"], block.get("sectionId") or block["id"]
            while open_headings and open_headings[-1][0] >= level:
                open_headings.pop()
            open_headings.append((level, text, section))
            for r in record(block["id"], "heading", text, page, section):
                yield r | {"heading": text}
            return
        section = block.get("sectionId") or (open_headings[-1][2] if open_headings else outside)
        if kind == "paragraph":
            yield from record(block["id"], kind, _runs(block.get("text")), page, section)
        elif kind == "figure":
            yield from record(block["id"], "figure-caption", _runs(block.get("caption")), page, section)
        elif kind == "list":
            for item in block.get("items", []):
                yield from record(item["id"], "list-item", _blocks_text(item.get("blocks", [])), page, section)
                for child in item.get("blocks", []):
                    if child.get("type") == "list":
                        yield from visit(child, section)
        elif kind == "table":
            rows = [row.get("cells", []) for row in block.get("rows", [])]
            columns = [_blocks_text(c.get("blocks", [])) for c in rows[0]] if rows else []
            for cells in rows:
                first = next((c for c in cells if c.get("isHeader")), None)
                label = _blocks_text(first.get("blocks", [])) if first else ""
                for i, cell in enumerate(cells):
                    above = columns[i] if i < len(columns) else ""
                    yield from record(cell["id"], "table-cell", _blocks_text(cell.get("blocks", [])), cell.get("pageNumber"), section, above, "" if cell is first else label)

    for page in document.get("pages", []):
        for block in page.get("blocks", []):
            yield from visit(block, f"page-{page['pageNumber']}")


def semantic_ids(document: dict) -> list[str]:
    """Ids of all blocks, list items and cells, in reading order."""
    out: list[str] = []

    def visit(block: dict) -> None:
        out.append(block["id"])
        parts = block.get("items", []) if block.get("type") == "list" else [c for row in block.get("rows", []) for c in row.get("cells", [])] if block.get("type") == "table" else []
        for part in parts:
            out.append(part["id"])
            for child in part.get("blocks", []):
                visit(child)

    for page in document.get("pages", []):
        for block in page.get("blocks", []):
            visit(block)
    return out


def outline_rows(document: dict) -> Iterator[dict]:
    """The outline, flattened: path of ordinals, level, title, target."""

    def visit(items: list, path: list[int]) -> Iterator[dict]:
        for i, item in enumerate(items):
            here = [*path, i]
            target = item.get("target") or item.get("link") or {}
            yield {"ordinal_path": here, "level": len(here), "title": item.get("title", ""), "target_page": target.get("pageNumber"), "target_href": target.get("href")}
            yield from visit(item.get("children") or [], here)

    yield from visit(document.get("outline") or [], [])


OUTLINE = "document_id string, ordinal_path array<int>, level int, title string, target_page int, target_href string"


def flatten_outline(documents: DataFrame) -> DataFrame:
    """OUTLINE rows of documents (document_id, title, semantic); none of what is no JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = pa.schema([("document_id", pa.string()), ("ordinal_path", pa.list_(pa.int32())), ("level", pa.int32()), ("title", pa.string()), ("target_page", pa.int32()), ("target_href", pa.string())])
        for batch in batches:
            rows: list[dict] = []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [{"document_id": one, **r} for r in outline_rows(json.loads(text))]
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue  # flatten() says why
            yield pa.RecordBatch.from_pylist(rows, form)

    return documents.select("document_id", "semantic").mapInArrow(run, OUTLINE)


def flatten(documents: DataFrame) -> DataFrame:
    """RECORD rows of documents (document_id, title, semantic): a document that fails fails alone.

    Its only row then has a null block_id and the reason as text; split_failures() separates them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        form = pa.schema([(n, pa.list_(pa.string()) if n == "heading_path" else pa.int32() if n in ("page_number", "ordinal") else pa.string()) for n in names])
        for batch in batches:
            rows: list[dict] = []
            for one, title, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    rows += [r | {"ordinal": i} for i, r in enumerate(records(json.loads(text), one, title))]
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    rows.append(dict.fromkeys(names) | {"document_id": one, "text": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, form)

    return documents.select("document_id", "title", "semantic").mapInArrow(run, RECORD)


def split_failures(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, failures): failures have document_id and reason."""
    return flat.where("block_id is not null"), flat.where("block_id is null").select("document_id", F.col("text").alias("reason"))


def known_blocks(documents: DataFrame) -> DataFrame:
    """document_id, block_id of all blocks, items and cells of documents (document_id, title, semantic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = pa.schema([("document_id", pa.string()), ("block_id", pa.string())])
        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    ids = semantic_ids(json.loads(text))
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue  # flatten() says why
                yield pa.RecordBatch.from_pydict({"document_id": [one] * len(ids), "block_id": ids}, form)

    return documents.select("document_id", "semantic").mapInArrow(run, "document_id string, block_id string")


def with_title(semantic: Column, title: Column) -> Column:
    """The JSON with metadata.displayTitle set: the chosen title travels with the document."""
    shown = F.to_json(F.struct(title.alias("displayTitle")))
    body = F.regexp_replace(shown, r"^\{|\}$", "")
    opened = r'^(\s*\{\s*"metadata"\s*:\s*\{)(\s*"displayTitle"\s*:\s*(?:null|"(?:[^"\\]|\\.)*")\s*,?)?'
    rest = F.regexp_replace(semantic, opened, "")
    comma = F.when(rest.rlike(r"^\s*\}"), "").otherwise(",")
    return F.when(semantic.rlike(opened), F.concat(F.regexp_extract(semantic, opened, 1), body, comma, rest)).otherwise(semantic)


def validate(flat: DataFrame, known_ids: DataFrame | None) -> DataFrame:
    """Records that may not be imported, each with a reason: unknown block, type, length, ids, repeated block.

    known_ids: document_id, block_id of all blocks of the documents; None where that is not asked.
    """
    from scriptorium.functions.titles import is_safe_id

    counted = flat.groupBy("document_id", "block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    reason = F.when(~F.col("block_type").isin(*BLOCK_TYPES), "block type is not allowed")
    reason = reason.when(~F.length("text").between(1, 20_000), "text length is invalid").when(~is_safe_id(F.col("section_id")) | ~is_safe_id(F.col("block_id")), "invalid id")
    bad = flat.select("document_id", "block_id", reason.alias("reason")).where("reason is not null")
    bad = bad.unionByName(counted.select("document_id", "block_id", F.lit("repeated block").alias("reason")))
    if known_ids is None:
        return bad
    return bad.unionByName(flat.join(known_ids, ["document_id", "block_id"], "left_anti").select("document_id", "block_id", F.lit("references an unknown block").alias("reason")))
