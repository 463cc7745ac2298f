"""Tagged structure, outline and links of a PDF file, and semantic blocks of its pages."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from scriptorium.sources import pdf_layout as G
from scriptorium.sources.pdf_objects import Page, Pdf, Ref, text_string, tree, warning
from scriptorium.sources.pdf_text import Fragment

#: Standard structure roles.
ROLES = frozenset(
    "Document Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private P H H1 H2 H3 H4 H5 H6 L LI Lbl LBody Table TR TH TD THead TBody TFoot "
    "Span Quote Note Reference BibEntry Code Link Annot Ruby Warichu Figure Formula Form".split()
)
_INLINE = {"Span", "Link", "Lbl", "Code"}
_PLAIN_INLINE = {"Span", "Reference", "Code", "Lbl"}
MAX_OUTLINE = 20_000
_NUMBERED = re.compile(r"(?:[A-Z]\d+|\d+)(?:\.\d+)*\.\s")
_NUMBERED_DEEP = re.compile(r"(?:[A-Z]\d+|\d+)(?:\.\d+)+\.\s")


class Ids:
    """h-1, h-2, p-1, ... in the order of asking."""

    def __init__(self):
        self.counts: Counter = Counter()

    def next(self, prefix: str) -> str:
        self.counts[prefix] += 1
        return f"{prefix}-{self.counts[prefix]}"


def slug(text: str) -> str:
    """Letters and digits without marks, joined by hyphens."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "-", plain.lower()).strip("-")


# -- the structure tree --------------------------------------------------------------------------


@dataclass
class Element:
    role: str
    raw_role: str
    #: Elements, ("mcid", page number, id) and ("object", Ref), in order.
    kids: list = field(default_factory=list)
    alt: str | None = None
    title: str | None = None
    col_span: int = 1
    row_span: int = 1

    def on(self, page: int, claimed: set[int]) -> Element | None:
        """What of the element lies on a page; an id belongs to the first element that claims it."""
        kids: list = []
        for kid in self.kids:
            if isinstance(kid, Element):
                if part := kid.on(page, claimed):
                    kids.append(part)
            elif kid[0] == "mcid":
                if kid[1] == page and kid[2] not in claimed:
                    claimed.add(kid[2])
                    kids.append(kid)
            elif kid[1] in (page, None):
                kids.append(kid)
        if not any(isinstance(k, Element) or k[0] == "mcid" for k in kids):
            return None
        return Element(self.role, self.raw_role, kids, self.alt, self.title, self.col_span, self.row_span)


def structure(pdf: Pdf, numbers: dict[Ref, int]) -> list[Element]:
    """The top elements of the structure tree; none for untagged files."""
    top = pdf.get(pdf.root.get("StructTreeRoot"))
    if not isinstance(top, dict):
        return []
    roles = {k: str(pdf.get(v)) for k, v in (pdf.get(top.get("RoleMap")) or {}).items()}
    seen: set[Ref] = set()

    def role_of(raw: str) -> str:
        name = raw
        for _ in range(16):
            if name in ROLES:
                return name
            if name not in roles:
                break
            name = roles[name]
        return "Unknown"

    def spans(info: dict) -> tuple[int, int]:
        found = {}
        own = pdf.get(info.get("A"))
        for a in own if isinstance(own, list) else [own]:
            a = pdf.get(a)
            if isinstance(a, dict):
                found |= {k: pdf.get(a[k]) for k in ("ColSpan", "RowSpan") if k in a}
        pick = lambda k: found[k] if isinstance(found.get(k), int) and found[k] > 0 else 1
        return pick("ColSpan"), pick("RowSpan")

    def kids(value, page: int | None, depth: int) -> Iterator:
        value = value if isinstance(value, Ref) else pdf.get(value)
        for kid in pdf.get(value) if isinstance(pdf.get(value), list) else [value]:
            ref, item = kid if isinstance(kid, Ref) else None, pdf.get(kid)
            if isinstance(item, int):
                yield ("mcid", page, item)
            elif isinstance(item, dict):
                here = numbers.get(item.get("Pg"), page)
                if item.get("Type") == "MCR" or "MCID" in item:
                    yield ("mcid", here, pdf.get(item.get("MCID")))
                elif item.get("Type") == "OBJR":
                    yield ("object", here, item.get("Obj"))
                elif ref is None or ref not in seen:
                    seen.add(ref)
                    if made := element(item, here, depth + 1):
                        yield made

    def element(info: dict, page: int | None, depth: int) -> Element | None:
        if depth > 4 * pdf.limits["max_nesting"]:
            return None
        raw = str(pdf.get(info.get("S")) or "")
        own = numbers.get(info.get("Pg"), page)
        alt, title = pdf.get(info.get("Alt")), pdf.get(info.get("T"))
        return Element(role_of(raw), raw, list(kids(info.get("K"), own, depth)), text_string(alt) or None, text_string(title) or None, *spans(info))

    return [k for k in kids(top.get("K"), None, 0) if isinstance(k, Element)]


# -- links and outline ---------------------------------------------------------------------------


class Targets:
    """Where destinations, actions and links lead: a page or an outside address."""

    def __init__(self, pdf: Pdf, numbers: dict[Ref, int]):
        self.pdf, self.numbers = pdf, numbers
        self.named = {str(k): v for k, v in (pdf.get(pdf.root.get("Dests")) or {}).items()}
        names = pdf.get(pdf.root.get("Names"))
        if isinstance(names, dict):
            for key, value in tree(pdf, names.get("Dests"), "Names"):
                if isinstance(key, bytes):
                    self.named.setdefault(text_string(key), value)

    def destination(self, value, depth: int = 0) -> dict | None:
        value = self.pdf.get(value)
        if depth > 8:
            return None
        if isinstance(value, dict):
            return self.destination(value.get("D"), depth + 1)
        if isinstance(value, (bytes, str)):
            name = text_string(value) if isinstance(value, bytes) else str(value)
            return self.destination(self.named[name], depth + 1) if name in self.named else None
        if isinstance(value, list) and value:
            page = self.numbers.get(value[0]) if isinstance(value[0], Ref) else value[0] + 1 if isinstance(value[0], int) else None
            return {"kind": "internal", "pageNumber": page} if page else None
        return None

    def action(self, value) -> dict | None:
        value = self.pdf.get(value)
        if not isinstance(value, dict):
            return None
        kind = str(self.pdf.get(value.get("S")))
        if kind == "URI":
            address = text_string(self.pdf.get(value.get("URI"))).strip()
            return {"kind": "external", "href": address} if re.match(r"(?i)(https?://|mailto:)", address) else None
        return self.destination(value.get("D")) if kind == "GoTo" else None

    def of(self, info: dict) -> dict | None:
        return self.destination(info["Dest"]) if info.get("Dest") is not None else self.action(info.get("A"))


def outline(pdf: Pdf, targets: Targets) -> list[dict]:
    seen: set[Ref] = set()

    def items(value, level: int) -> list[dict]:
        out = []
        while isinstance(value, Ref) and value not in seen and len(seen) < MAX_OUTLINE and level <= pdf.limits["max_nesting"]:
            seen.add(value)
            info = pdf.get(value)
            if not isinstance(info, dict):
                break
            item = {"title": text_string(pdf.get(info.get("Title"))), "level": level, "children": items(info.get("First"), level + 1)}
            if target := targets.of(info):
                item["target"] = target
            out.append(item)
            value = info.get("Next")
        return out

    top = pdf.get(pdf.root.get("Outlines"))
    return items(top.get("First"), 1) if isinstance(top, dict) else []


# -- blocks --------------------------------------------------------------------------------------


def _text(runs: list[dict]) -> str:
    return "".join(r["text"] for r in runs)


class Blocks:
    """Semantic blocks of one page from its elements, or from positions alone."""

    def __init__(self, page: int, ids: Ids, by_mcid: dict[int, list[Fragment]], images: dict[int, list[str]], link_of, warnings: list):
        self.page, self.ids, self.by_mcid, self.images, self.link_of, self.warnings = page, ids, by_mcid, images, link_of, warnings

    def warn(self, message: str, code: str = "structure-inconsistency") -> None:
        self.warnings.append(warning(code, message, self.page))

    def block(self, kind: str, prefix: str, **more) -> dict:
        return {"type": kind, "id": self.ids.next(prefix), "pageNumber": self.page, **more}

    # inline text

    def mcid_runs(self, mcid: int) -> list[dict]:
        text = " ".join(line.text for line in G.lines(self.by_mcid.get(mcid, [])))
        return [{"text": text}] if text else []

    @staticmethod
    def join(runs: list[dict], more: list[dict]) -> list[dict]:
        if runs and more and not re.search(r"\s\Z|\A\Z", runs[-1]["text"]) and not re.match(r"\s|\Z", more[0]["text"]):
            runs = [*runs, {"text": " "}]
        return [*runs, *more]

    def inline(self, kids: list) -> list[dict]:
        runs: list[dict] = []
        for kid in kids:
            if isinstance(kid, Element):
                if kid.role in ("L", "Table", "Figure") or re.fullmatch("H[1-6]?", kid.role):
                    self.warn(f"A {kid.raw_role} element inside running text was flattened.")
                runs = self.join(runs, self.linked(kid))
            elif kid[0] == "mcid":
                runs = self.join(runs, self.mcid_runs(kid[2]))
        return runs

    def linked(self, e: Element) -> list[dict]:
        runs = self.inline(e.kids)
        target = self.link_of(e) if e.role == "Link" else None
        return [{**r, "link": r.get("link", target)} for r in runs] if target else runs

    def fragments(self, kids: list) -> list[Fragment]:
        mcids: dict[int, None] = {}

        def visit(items: list) -> None:
            for k in items:
                if isinstance(k, Element):
                    visit(k.kids)
                elif k[0] == "mcid":
                    mcids[k[2]] = None

        visit(kids)
        return [f for m in mcids for f in self.by_mcid.get(m, [])]

    def positioned(self, kids: list) -> str:
        """Text of all that lies below, spaced by positions rather than by element borders."""
        return " ".join(G.joined(sorted(row, key=lambda f: f.x)) for row in G.rows(self.fragments(kids)))

    # blocks

    def build(self, kids: list) -> list[dict]:
        out: list[dict] = []
        runs: list[dict] = []

        def flush() -> None:
            nonlocal runs
            if _text(runs).strip():
                out.append(self.block("paragraph", "p", text=runs))
            runs = []

        for kid in kids:
            if not isinstance(kid, Element):
                if kid[0] == "mcid":
                    runs = self.join(runs, self.mcid_runs(kid[2]))
                continue
            if kid.role in _INLINE:
                runs = self.join(runs, self.linked(kid))
                continue
            flush()
            if kid.role == "P":
                out += self.paragraph(kid)
            elif kid.role == "TOCI":
                if text := " ".join(self.positioned(kid.kids).split()):
                    out.append(self.block("paragraph", "p", text=[{"text": text}]))
            elif re.fullmatch("H[1-6]?", kid.role):
                out += self.heading(kid)
            elif kid.role == "L":
                made = self.list(kid)
                out.append(self.only_numbered(made) or made)
            elif kid.role == "Table":
                out.append(self.table(kid))
            elif kid.role == "Figure":
                out.append(self.figure(kid))
            else:
                out += self.build(kid.kids)
        flush()
        return out

    def heading(self, e: Element) -> list[dict]:
        runs = self.inline(e.kids)
        if not _text(runs).strip():
            self.warn(f"A {e.raw_role} heading without text was left out.")
            return []
        if e.role == "H":
            self.warn("A heading without a level was taken for level 2.")
        return [self.block("heading", "h", level=int(e.role[1:] or 2), text=runs)]

    def paragraph(self, e: Element) -> list[dict]:
        if len(e.kids) > 1 and all(not isinstance(k, Element) and k[0] == "mcid" for k in e.kids):
            parts = [self.mcid_runs(k[2]) for k in e.kids]
            if all(_NUMBERED.match(_text(p).lstrip()) for p in parts):
                return [self.block("paragraph", "p", text=p) for p in parts]
        found = self.fragments(e.kids)
        if len({f.mcid for f in found}) > 1 and self.plain(e.kids):
            if text := re.sub(r"[ \t]+", " ", self.positioned(e.kids)).strip():
                return [self.block("paragraph", "p", text=[{"text": text}])]
        runs = self.inline(e.kids)
        return [self.block("paragraph", "p", text=runs)] if _text(runs).strip() else []

    def plain(self, kids: list) -> bool:
        return all(not isinstance(k, Element) or k.role in _PLAIN_INLINE and self.plain(k.kids) for k in kids)

    def item(self, kids: list, label: str | None, labelled: bool) -> dict:
        blocks = self.build(kids)
        first = blocks[0] if blocks and blocks[0]["type"] == "paragraph" else None
        if label:
            if first:
                first["text"] = [{"text": f"{label} "}, *first["text"]]
            else:
                blocks.insert(0, self.block("paragraph", "p", text=[{"text": label}]))
        elif not labelled and first and (m := re.match(r"o\s+", _text(first["text"]))):
            # a bullet that was drawn as the letter o
            left, rest = m.end(), []
            for r in first["text"]:
                cut = min(left, len(r["text"]))
                left -= cut
                if len(r["text"]) > cut:
                    rest.append({**r, "text": r["text"][cut:]})
            blocks[0] = {**first, "id": self.ids.next("p"), "text": rest}
        return {"id": self.ids.next("li"), "blocks": blocks}

    def list(self, e: Element) -> dict:
        items, ordered = [], None
        for kid in e.kids:
            if not isinstance(kid, Element):
                continue
            if kid.role != "LI":
                self.warn(f"A list holds a {kid.raw_role} element; it was taken for an item.")
                items.append(self.item(kid.kids, None, True))
                continue
            label, labelled, body = None, False, []
            for part in kid.kids:
                role = part.role if isinstance(part, Element) else ""
                if role == "Lbl":
                    labelled, label = True, _text(self.inline(part.kids)).strip()
                else:
                    body += part.kids if role == "LBody" else [part]
            if label and ordered is None:
                ordered = bool(re.match(r"[A-Za-z0-9]+[.):]", label))
            items.append(self.item(body, label, labelled))
        return self.block("list", "list", ordered=bool(ordered), items=items)

    def only_numbered(self, made: dict) -> dict | None:
        """A list of one numbered paragraph is that paragraph."""
        if len(made["items"]) != 1 or len(made["items"][0]["blocks"]) != 1:
            return None
        only = made["items"][0]["blocks"][0]
        if only["type"] == "list":
            return self.only_numbered(only)
        return only if only["type"] == "paragraph" and _NUMBERED_DEEP.match(_text(only["text"]).lstrip()) else None

    def table(self, e: Element) -> dict:
        rows = []
        for part in e.kids:
            if not isinstance(part, Element):
                continue
            body = part.kids if part.role in ("THead", "TBody", "TFoot") else [part]
            for row in body:
                if not isinstance(row, Element):
                    continue
                if row.role != "TR":
                    self.warn(f"A table holds a {row.raw_role} element; it was left out.")
                    continue
                cells = []
                for cell in row.kids:
                    if not isinstance(cell, Element):
                        continue
                    if cell.role not in ("TH", "TD"):
                        self.warn(f"A table row holds a {cell.raw_role} element; it was left out.")
                        continue
                    blocks, head = self.build(cell.kids), part.role == "THead" or cell.role == "TH"
                    cells.append({"id": self.ids.next("th" if head else "td"), "pageNumber": self.page, "blocks": blocks, "isHeader": head, "colSpan": cell.col_span, "rowSpan": cell.row_span})
                rows.append({"cells": cells})
        return self.block("table", "table", rows=rows)

    def figure(self, e: Element) -> dict:
        image = next((self.images[k[2]][0] for k in e.kids if not isinstance(k, Element) and k[0] == "mcid" and self.images.get(k[2])), None)
        known = image is not None
        if not known:
            image = self.ids.next("fig-placeholder")
            self.warn("A figure has no supported image; a placeholder stands for it.", "unsupported-image")
        caption = next((self.inline(k.kids) for k in e.kids if isinstance(k, Element) and k.role == "Caption"), [])
        out = self.block("figure", "fig", imageId=image, unsupported=not known)
        return out | ({"altText": e.alt} if e.alt else {}) | ({"caption": caption} if caption else {})

    def from_positions(self, fragments: list[Fragment]) -> list[dict]:
        """Paragraphs, and headings where a lone line is clearly larger than the page's text."""
        found = G.lines(fragments)
        for line in found:
            if not line.level:
                self.warn("Text that is not horizontal was kept as a line of its own.", "ambiguous-reading-order")
        groups = G.paragraphs(found)
        body, out = G.body_size(groups), []
        for group in groups:
            text = " ".join(line.text for line in group).strip()
            if not text:
                continue
            level = G.heading_level(group[0].size / max(1.0, body)) if len(group) == 1 else None
            if level:
                self.warn("A heading's level was taken from its size.", "ambiguous-reading-order")
                out.append(self.block("heading", "h", level=level, text=[{"text": group[0].text}]))
            else:
                out.append(self.block("paragraph", "p", text=[{"text": text}]))
        return out


def page_blocks(page: Page, elements: list[Element], fragments: list[Fragment], images: dict[int, list[str]], ids: Ids, link_of, warnings: list) -> list[dict]:
    """The page's blocks: from its elements, then what no element claims; from positions if untagged."""
    content = [f for f in fragments if not f.artifact]
    by_mcid: dict[int, list[Fragment]] = {}
    for f in content:
        if f.mcid is not None:
            by_mcid.setdefault(f.mcid, []).append(f)
    blocks = Blocks(page.number, ids, by_mcid, images, link_of, warnings)
    claimed: set[int] = set()
    parts = [p for p in (e.on(page.number, claimed) for e in elements) if p]
    if not parts:
        return blocks.from_positions(content)
    orphans = {m for m in by_mcid if m not in claimed}
    if orphans:
        warnings.append(warning("structure-inconsistency", f"{len(orphans)} marked parts of the page belong to no element.", page.number))
    loose = [f for f in content if f.mcid is None or f.mcid in orphans]
    return blocks.build(parts) + (blocks.from_positions(loose) if loose else [])
