"""PDF syntax and file structure: objects, cross-references, streams, page tree.

Runs inside Python workers on one file's bytes. Values are plain Python: None, bool, int, float,
bytes (strings), Name, list, dict (keys without the slash), Ref and Stream. What goes wrong in a way
that ends a file raises PdfError with a code; what can be gone round is a warning of the caller.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Safety limits and their defaults.
LIMITS = {
    "max_input_bytes": 512 << 20,
    "max_objects": 500_000,
    "max_object_stream_bytes": 256 << 20,
    "max_stream_bytes": 128 << 20,
    "max_ratio": 300,
    "max_reference_depth": 64,
    "max_page_depth": 64,
    "max_operations": 200_000,
    "max_image_side": 20_000,
    "max_image_pixels": 64_000_000,
    "max_cmap_bytes": 16 << 20,
    "max_cmap_entries": 2_000_000,
    "max_nesting": 64,
    "max_token": 64 << 10,
}


class PdfError(Exception):
    """code: invalid-header, unsupported-encryption, corrupt-structure, limit-exceeded, unsupported-feature."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Name(str):
    __slots__ = ()


class Keyword(str):
    __slots__ = ()


class Ref(NamedTuple):
    number: int
    generation: int


class Stream(NamedTuple):
    info: dict
    raw: bytes


_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_TAIL = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)+(\d+)(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_STRING = re.compile(rb"[()\\]|\r\n?")
#: What follows the `[` of an array of nothing but integers.
_INTEGERS = re.compile(rb"[\t\n\x0c\r ]*+(?:[+-]?\d++(?:[\t\n\x0c\r ]++|(?=\])))*+\]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Reader:
    """Values one after the other from a place in some bytes; references: whether `1 0 R` is one."""

    def __init__(self, data: bytes, at: int = 0, limits: dict = LIMITS, references: bool = True):
        self.data, self.at, self.limits, self.references = data, at, limits, references

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        """The next value; a Keyword for anything else, and for `]`, `>>` and, at the end, ""."""
        if depth > self.limits["max_nesting"]:
            raise PdfError("limit-exceeded", "Values are nested too deeply.")
        self.skip()
        data, at = self.data, self.at
        c = data[at : at + 1]
        if not c:
            return Keyword("")
        if c in b"+-.0123456789" and (m := _NUMBER.match(data, at)):
            self.at = m.end()
            text = m[0]
            if b"." in text:
                return float(text)
            if self.references and (r := _TAIL.match(data, m.end())) and text.isdigit():
                self.at = r.end()
                return Ref(int(text), int(r[1]))
            return int(text)
        if c == b"/":
            m = _REGULAR.match(data, at + 1)
            self._bounded(m.end() - at)
            self.at = m.end()
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0]) if b"#" in m[0] else m[0]
            return Name(raw.decode("latin-1"))
        if c == b"(":
            return self._literal()
        if data.startswith(b"<<", at):
            self.at += 2
            out: dict = {}
            while True:
                key = self.value(depth + 1)
                if isinstance(key, Keyword) and key in (">>", ""):
                    return out
                item = self.value(depth + 1)
                if isinstance(item, Keyword) and item == ">>":
                    return out
                if isinstance(key, Name):
                    out[str(key)] = _plain(item)
        if data.startswith(b">>", at):
            self.at += 2
            return Keyword(">>")
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self._bounded(end - at)
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            if depth < self.limits["max_nesting"] and (m := _INTEGERS.match(data, self.at)):
                self.at = m.end()
                return [int(x) for x in m[0][:-1].split()]
            items = []
            while True:
                item = self.value(depth + 1)
                if isinstance(item, Keyword) and item in ("]", ""):
                    return items
                items.append(_plain(item))
        if c in b"]{})>":
            self.at += 1
            return Keyword(c.decode("latin-1"))
        m = _REGULAR.match(data, at)
        self._bounded(m.end() - at)
        self.at = m.end()
        word = m[0].decode("latin-1")
        return {"true": True, "false": False, "null": None}.get(word, Keyword(word))

    def _bounded(self, size: int) -> None:
        if size > self.limits["max_token"]:
            raise PdfError("limit-exceeded", "A token is too long.")

    def _literal(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, []
        first = at
        while depth:
            m = _STRING.search(data, at)
            if m is None:
                out.append(data[at:])
                at = len(data)
                break
            out.append(data[at : m.start()])
            at, c = m.end(), m[0]
            if c == b"(":
                depth += 1
                out.append(c)
            elif c == b")":
                depth -= 1
                out.append(c if depth else b"")
            elif c == b"\\":
                nxt = data[at : at + 1]
                if o := re.compile(rb"[0-7]{1,3}").match(data, at):
                    out.append(bytes([int(o[0], 8) & 255]))
                    at = o.end()
                elif nxt in (b"\r", b"\n"):
                    at += 2 if data.startswith(b"\r\n", at) else 1
                else:
                    out.append(_ESCAPES.get(nxt, nxt))
                    at += 1
            else:
                out.append(b"\n")
            self._bounded(at - first)
        self.at = at
        return b"".join(out)


def _plain(value):
    """Stray keywords inside arrays and dictionaries count as null."""
    return None if isinstance(value, Keyword) else value


# -- streams -------------------------------------------------------------------------------------


def inflate(raw: bytes, limit: int, ratio: int) -> bytes:
    """zlib data, as far as it goes; too much, or too much for its size, is an error."""
    worker, out = zlib.decompressobj(), b""
    try:
        out = worker.decompress(raw, limit + 1)
    except zlib.error:
        worker = zlib.decompressobj()
        parts, size = [], 0
        for i in range(0, len(raw), 1024):  # what comes before the damage
            try:
                part = worker.decompress(raw[i : i + 1024], limit + 1 - size)
            except zlib.error:
                break
            parts.append(part)
            size += len(part)
            if size > limit:
                break
        out = b"".join(parts)
        if not out and raw:
            raise PdfError("corrupt-structure", "A compressed stream is damaged.") from None
    if len(out) > limit or len(out) > 4096 and len(out) > ratio * max(1, len(raw)):
        raise PdfError("limit-exceeded", "A compressed stream expands too far.")
    return out


def unpredict(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    if kind in (1, None):
        return data
    step = max(1, colors * bits // 8)
    width = (colors * bits * columns + 7) // 8
    if kind == 2:
        if bits != 8:
            raise PdfError("unsupported-feature", "TIFF prediction of other than 8 bits.")
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    if not 10 <= kind <= 15:
        raise PdfError("unsupported-feature", f"Predictor {kind}.")
    out, above = bytearray(), np.zeros(width, np.uint8)
    for at in range(0, len(data), width + 1):
        how, row = data[at], np.frombuffer(data[at + 1 : at + 1 + width].ljust(width, b"\0"), np.uint8)
        if how == 1:
            pad = -width % step
            cells = np.concatenate([row, np.zeros(pad, np.uint8)]).reshape(-1, step)
            row = np.cumsum(cells, axis=0, dtype=np.uint8).ravel()[:width]
        elif how == 2:
            row = row + above
        elif how in (3, 4):
            now = bytearray(row.tobytes())
            up = above.tobytes()
            for i in range(width):
                a = now[i - step] if i >= step else 0
                b = up[i]
                if how == 3:
                    guess = (a + b) // 2
                else:
                    c = up[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[i] = (now[i] + guess) & 255
            row = np.frombuffer(bytes(now), np.uint8)
        out += row.tobytes()
        above = row
    return bytes(out)


# -- documents -----------------------------------------------------------------------------------


class Page(NamedTuple):
    number: int
    ref: Ref | None
    info: dict
    media_box: tuple[float, float, float, float]
    rotate: int
    resources: dict


class Pdf:
    """One file: trailer, objects by number, decoded streams, pages."""

    def __init__(self, data: bytes, limits: dict | None = None):
        self.limits = LIMITS | (limits or {})
        if len(data) > self.limits["max_input_bytes"]:
            raise PdfError("limit-exceeded", "The file is too large.")
        head = data[:1024].find(b"%PDF-")
        if head < 0:
            raise PdfError("invalid-header", "Not a PDF file.")
        self.data, self.warnings = data, []
        self.entries: dict[int, tuple] = {}  # number: ("at", offset) or ("in", stream, index)
        self.trailer: dict = {}
        self._known: dict[int, object] = {}
        self._open: set[int] = set()
        self._packed: dict[int, dict[int, object]] = {}
        self._sections()
        if self.trailer.get("Encrypt") is not None:
            raise PdfError("unsupported-encryption", "Encrypted files are not supported.")
        self.root = self.get(self.trailer.get("Root"))
        if not isinstance(self.root, dict):
            raise PdfError("corrupt-structure", "The document has no catalog.")

    # cross-references: the newest section is read first, and what it says stays

    def _sections(self) -> None:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - 2048))
        start = Reader(self.data, at + 9).value() if at >= 0 else None
        if not isinstance(start, int):
            raise PdfError("corrupt-structure", "No startxref.")
        todo, seen = [start], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            if len(seen) > 1024 or not 0 <= at < len(self.data):
                raise PdfError("corrupt-structure", "The chain of cross-references is broken.")
            seen.add(at)
            reader = Reader(self.data, at, self.limits)
            first = reader.value()
            trailer = self._table(reader) if first == "xref" and isinstance(first, Keyword) else self._stream_section(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo = [x for x in (trailer.get("XRefStm"), trailer.get("Prev")) if isinstance(x, int)] + todo
        if len(self.entries) > self.limits["max_objects"]:
            raise PdfError("limit-exceeded", "Too many objects.")

    def _table(self, reader: Reader) -> dict:
        reader.references = False
        while True:
            first = reader.value()
            if isinstance(first, Keyword):
                break
            count = reader.value()
            if not isinstance(first, int) or not isinstance(count, int) or count > self.limits["max_objects"]:
                raise PdfError("corrupt-structure", "A cross-reference table is damaged.")
            for number in range(first, first + count):
                offset, _, kind = reader.value(), reader.value(), reader.value()
                if kind == "n" and isinstance(offset, int):
                    self.entries.setdefault(number, ("at", offset))
                elif kind == "f":
                    self.entries.setdefault(number, ("free",))
                else:
                    raise PdfError("corrupt-structure", "A cross-reference table is damaged.")
        reader.references = True
        trailer = reader.value() if first == "trailer" else None
        if not isinstance(trailer, dict):
            raise PdfError("corrupt-structure", "No trailer.")
        return trailer

    def _stream_section(self, at: int) -> dict:
        value = self._object_at(at)
        if not isinstance(value, Stream):
            raise PdfError("corrupt-structure", "No cross-reference section where one should be.")
        info, data = value.info, self.decoded(value)
        widths = info.get("W")
        if not isinstance(widths, list) or len(widths) < 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths[:3]):
            raise PdfError("corrupt-structure", "A cross-reference stream is damaged.")
        spans = info.get("Index") or [0, info.get("Size", 0)]
        place, size = 0, sum(widths[:3])
        for first, count in zip(spans[::2], spans[1::2]):
            for number in range(first, first + count):
                if place + size > len(data):
                    return info
                parts, i = [], place
                for w in widths[:3]:
                    parts.append(int.from_bytes(data[i : i + w], "big"))
                    i += w
                kind = parts[0] if widths[0] else 1
                self.entries.setdefault(number, ("at", parts[1]) if kind == 1 else ("in", parts[1], parts[2]) if kind == 2 else ("free",))
                place += size
        return info

    # objects

    def _object_at(self, at: int, number: int | None = None):
        reader = Reader(self.data, at, self.limits)
        head = [reader.value(), reader.value(), reader.value()]
        if not isinstance(head[0], int) or head[2] != "obj" or number not in (None, head[0]):
            raise PdfError("corrupt-structure", f"No object at byte {at}.")
        value = reader.value()
        if isinstance(value, dict):
            reader.skip()
            if self.data.startswith(b"stream", reader.at):
                at = reader.at + 6
                at += 2 if self.data.startswith(b"\r\n", at) else 1 if self.data[at : at + 1] in (b"\n", b"\r") else 0
                return Stream(value, self._raw(value, at))
        return _plain(value)

    def _raw(self, info: dict, at: int) -> bytes:
        """The stream's bytes: as long as it says if `endstream` follows, else up to it."""
        size = info.get("Length")
        if isinstance(size, Ref):
            try:
                size = self.get(size)
            except PdfError:
                size = None
        if isinstance(size, int) and size >= 0 and re.match(rb"\s*endstream", self.data[at + size : at + size + 32]):
            return self.data[at : at + size]
        end = self.data.find(b"endstream", at)
        if end < 0:
            raise PdfError("corrupt-structure", "A stream has no end.")
        return re.sub(rb"\r?\n\Z|\r\Z", b"", self.data[at:end])

    def get(self, value, depth: int = 0):
        """What a value refers to; null for free and missing objects."""
        if not isinstance(value, Ref):
            return value
        if depth > self.limits["max_reference_depth"] or value.number in self._open:
            raise PdfError("corrupt-structure", "References run in a circle.")
        if value.number not in self._known:
            self._open.add(value.number)
            try:
                kind, *where = self.entries.get(value.number, ("free",))
                found = self._object_at(where[0], value.number) if kind == "at" else self._unpacked(where[0]).get(value.number) if kind == "in" else None
            finally:
                self._open.discard(value.number)
            self._known[value.number] = found
        return self.get(self._known[value.number], depth + 1)

    def _unpacked(self, number: int) -> dict[int, object]:
        if number not in self._packed:
            stream = self.get(Ref(number, 0))
            if not isinstance(stream, Stream):
                raise PdfError("corrupt-structure", "An object stream is missing.")
            data = self.decoded(stream, "max_object_stream_bytes")
            head = Reader(data, 0, self.limits, references=False)
            n, first = self.get(stream.info.get("N")), self.get(stream.info.get("First"))
            if not isinstance(n, int) or not isinstance(first, int) or n > self.limits["max_objects"]:
                raise PdfError("corrupt-structure", "An object stream is damaged.")
            pairs = [(head.value(), head.value()) for _ in range(n)]
            self._packed[number] = {i: _plain(Reader(data, first + o, self.limits).value()) for i, o in pairs if isinstance(i, int) and isinstance(o, int)}
        return self._packed[number]

    def filters(self, stream: Stream) -> list[tuple[str, dict]]:
        names, parms = self.get(stream.info.get("Filter")), self.get(stream.info.get("DecodeParms"))
        names = [] if names is None else names if isinstance(names, list) else [names]
        parms = parms if isinstance(parms, list) else [parms] * len(names)
        return [(str(self.get(n)), {k: self.get(v) for k, v in (self.get(p) or {}).items()}) for n, p in zip(names, [*parms, *[None] * len(names)])]

    def decoded(self, stream: Stream, limit: str = "max_stream_bytes") -> bytes:
        data = stream.raw
        for name, parms in self.filters(stream):
            if name not in ("FlateDecode", "Fl"):
                raise PdfError("unsupported-feature", f"Filter {name}.")
            data = unpredict(inflate(data, self.limits[limit], self.limits["max_ratio"]), parms)
        return data

    # pages

    def pages(self) -> list[Page]:
        """All pages in order, with what they inherit; branches that repeat or go too deep are left out."""
        out: list[Page] = []
        seen: set[Ref] = set()

        def visit(value, inherited: dict, depth: int) -> None:
            if depth > self.limits["max_page_depth"]:
                raise PdfError("limit-exceeded", "The page tree is too deep.")
            ref = value if isinstance(value, Ref) else None
            if ref in seen and ref is not None:
                self.warnings.append(warning("structure-inconsistency", "A page tree node occurs twice."))
                return
            seen.add(ref)
            node = self.get(value)
            if not isinstance(node, dict):
                self.warnings.append(warning("structure-inconsistency", "A page tree node is missing."))
                return
            own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if node.get(k) is not None}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    visit(kid, own, depth + 1)
                return
            box = [self.get(x) for x in self.get(own.get("MediaBox")) or [0, 0, 612, 792]]
            if len(box) != 4 or not all(isinstance(x, (int, float)) for x in box):
                box = [0, 0, 612, 792]
            turn = self.get(own.get("Rotate"))
            turn = int(round((turn if isinstance(turn, (int, float)) else 0) / 90)) * 90 % 360
            resources = self.get(own.get("Resources"))
            out.append(Page(len(out) + 1, ref, node, (min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])), turn, resources if isinstance(resources, dict) else {}))

        top = self.get(self.root.get("Pages"))
        visit(self.root.get("Pages"), {}, 0)
        if isinstance(top, dict) and isinstance(self.get(top.get("Count")), int) and self.get(top["Count"]) != len(out):
            self.warnings.append(warning("structure-inconsistency", "The page tree's count differs from its pages."))
        return out

    def content(self, page: Page) -> bytes:
        """The page's content streams, one after the other, with line feeds between."""
        value = self.get(page.info.get("Contents"))
        parts = []
        for item in value if isinstance(value, list) else [value]:
            stream = self.get(item)
            if isinstance(stream, Stream):
                parts.append(self.decoded(stream))
        return b"\n".join(parts)


def warning(code: str, message: str, page: int | None = None) -> dict:
    return {"code": code, "message": message} | ({"pageNumber": page} if page else {})


#: Where PDFDocEncoding differs from Latin-1.
_PDF_DOC = dict(zip([*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0], "˘ˇˆ˙˝˛˚˜•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž€"))


def text_string(raw) -> str:
    """A PDF text string: UTF-16 with a mark, else PDFDocEncoding; NULs at the end go."""
    if not isinstance(raw, bytes):
        return ""
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace").rstrip("\0")
    return "".join(_PDF_DOC.get(b, chr(b)) for b in raw).rstrip("\0")


def tree(pdf: Pdf, node, key: str, depth: int = 0) -> Iterator[tuple]:
    """(key, value) pairs of a name tree (Names) or number tree (Nums)."""
    node = pdf.get(node)
    if not isinstance(node, dict) or depth > pdf.limits["max_page_depth"]:
        return
    pairs = pdf.get(node.get(key)) or []
    for i in range(0, len(pairs) - 1, 2):
        yield pdf.get(pairs[i]), pairs[i + 1]
    for kid in pdf.get(node.get("Kids")) or []:
        yield from tree(pdf, kid, key, depth + 1)
