"""Search filters: raw strings to a checked set, and the set to a Column."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of filters, and the block types that can be asked for.
MAX_ID = 128
MAX_PAGE = 100_000
MAX_PAGE_SPAN = 2_000
BLOCK_TYPES = ("heading", "paragraph", "list-item", "table-cell", "figure-caption")


class FilterError(ValueError):
    """A filter that is refused; the message is for the user."""


@dataclass(frozen=True)
class Filters:
    document_id: str | None = None
    page: int | None = None
    page_range: tuple[int, int] | None = None
    section_id: str | None = None
    block_type: str | None = None

    @property
    def empty(self) -> bool:
        return self == Filters()

    def condition(self) -> Column:
        """The conjunction of what is set; filters reach the scan."""
        parts = [F.col(c) == v for c, v in (("document_id", self.document_id), ("page_number", self.page), ("section_id", self.section_id), ("block_type", self.block_type)) if v is not None]
        if self.page_range:
            parts.append(F.col("page_number").between(*self.page_range))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def _id(value: str, label: str) -> str:
    if len(value) > MAX_ID or not re.fullmatch(r"[a-z][a-z0-9-]*", value):
        raise FilterError(f"Invalid {label} filter.")
    return value


def _page(value: str, label: str) -> int:
    if not re.fullmatch(r"[0-9]{1,10}", value) or not 1 <= int(value) <= MAX_PAGE:
        raise FilterError(f"Invalid {label} filter (must be an integer between 1 and {MAX_PAGE}).")
    return int(value)


def parse(document_id: str | None = None, page: str | None = None, page_start: str | None = None, page_end: str | None = None, section_id: str | None = None, block_type: str | None = None) -> Filters:
    """Filters from raw strings; None and "" mean not set."""
    if page and (page_start or page_end):
        raise FilterError("Specify either a page filter or a page range, not both.")
    if bool(page_start) != bool(page_end):
        raise FilterError("A page range filter requires both ends.")
    span = None
    if page_start and page_end:
        span = _page(page_start, "page range"), _page(page_end, "page range")
        if span[0] > span[1]:
            raise FilterError("The start of a page range must not exceed its end.")
        if span[1] - span[0] > MAX_PAGE_SPAN:
            raise FilterError(f"Page range is too large (max span {MAX_PAGE_SPAN} pages).")
    if block_type and block_type not in BLOCK_TYPES:
        raise FilterError(f"Invalid block type filter. Allowed values: {', '.join(BLOCK_TYPES)}.")
    return Filters(_id(document_id, "document id") if document_id else None, _page(page, "page") if page else None, span, _id(section_id, "section id") if section_id else None, block_type or None)
