"""Semantic documents as escaped HTML, one document at a time or as a column."""

from __future__ import annotations

import base64
import json
import re
from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _attributes(**values) -> str:
    return "".join(f' {k.rstrip("_")}="{escape(str(v))}"' for k, v in values.items() if v not in (None, "", 1) or k in ("id",) and v)


#: Where links may go.
SAFE_LINK = r"(?i)^(https?://|mailto:)"


def allowed(target: Column) -> Column:
    """Whether a link may go there."""
    return F.trim(target).rlike(SAFE_LINK)


def href(link: dict | None) -> str | None:
    """Where a link may go: a page, or a web or mail address; None for anything else."""
    if not link:
        return None
    if link.get("kind") == "internal" or link.get("pageNumber"):
        return f"#page={int(link['pageNumber'])}"
    target = (link.get("href") or "").strip()
    return target if re.match(SAFE_LINK, target) else None


def runs(items: list | None) -> str:
    out = []
    for r in items or []:
        text, target = escape(r.get("text", ""), quote=False), href(r.get("link"))
        out.append(f'<a href="{escape(target)}">{text}</a>' if target else text)
    return "".join(out)


def data_uri(mime_type: str, content: bytes) -> str:
    return f"data:{mime_type};base64,{base64.b64encode(content).decode()}"


def block(b: dict, images: dict[str, str] | None = None) -> str:
    """A block as HTML; images: where images lie, by id."""
    kind = b.get("type")
    ident = _attributes(id=b.get("id"))
    if kind == "heading":
        level = min(6, max(1, int(b.get("level", 1))))
        return f"<h{level}{ident}>{runs(b.get('text'))}</h{level}>"
    if kind == "paragraph":
        return f"<p{ident}>{runs(b.get('text'))}</p>"
    if kind == "list":
        tag = "ol" if b.get("ordered") else "ul"
        items = "".join(f"<li{_attributes(id=i.get('id'))}>{''.join(block(x, images) for x in i.get('blocks', []))}</li>" for i in b.get("items", []))
        return f"<{tag}{ident}>{items}</{tag}>"
    if kind == "table":
        rows = []
        for row in b.get("rows", []):
            cells = []
            for c in row.get("cells", []):
                tag = "th" if c.get("isHeader") else "td"
                cells.append(f"<{tag}{_attributes(id=c.get('id'), colspan=c.get('colSpan'), rowspan=c.get('rowSpan'))}>{''.join(block(x, images) for x in c.get('blocks', []))}</{tag}>")
            rows.append(f"<tr>{''.join(cells)}</tr>")
        return f"<table{ident}><tbody>{''.join(rows)}</tbody></table>"
    if kind == "figure":
        image = f'<img src="{escape((images or {}).get(b["imageId"], b["imageId"]))}" alt="{escape(b.get("altText") or "")}">' if b.get("imageId") and not b.get("unsupported") else ""
        caption = f"<figcaption>{runs(b['caption'])}</figcaption>" if b.get("caption") else ""
        return f"<figure{ident}>{image}{caption}</figure>"
    return ""


def render(document: dict, images: dict[str, str] | None = None) -> str:
    """A section for each page, everything escaped; images: where images lie, by id."""
    pages = "".join(f'<section id="page-{int(p["pageNumber"])}">{"".join(block(b, images) for b in p.get("blocks", []))}</section>' for p in document.get("pages", []))
    return f"<article>{pages}</article>"


def rendered(semantic: Column) -> Column:
    @F.pandas_udf("string")
    def made(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else render(json.loads(x)))

    return made(semantic)
