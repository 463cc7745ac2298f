"""Fonts and page content: positioned text and image placements of one page."""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass, field

from scriptorium.sources.pdf_objects import Keyword, Name, Page, Pdf, PdfError, Reader, Ref, Stream, warning

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


# -- glyph names and encodings -------------------------------------------------------------------

#: Glyph names that no rule gives.
_GLYPHS = dict(
    zip(
        "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash colon semicolon less equal greater question at "
        "bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde quoteleft quoteright quotedblleft quotedblright quotesinglbase quotedblbase "
        "endash emdash bullet ellipsis dagger daggerdbl perthousand guilsinglleft guilsinglright guillemotleft guillemotright fi fl ff ffi ffl germandbls ae AE oe OE oslash Oslash eth Eth thorn Thorn "
        "dotlessi lslash Lslash Euro cent sterling currency yen brokenbar section dieresis copyright ordfeminine ordmasculine logicalnot registered macron degree plusminus acute mu paragraph "
        "periodcentered cedilla multiply divide exclamdown questiondown trademark minus florin fraction circumflex tilde caron breve dotaccent ring ogonek hungarumlaut nbspace softhyphen".split(),
        " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‘’“”‚„–—•…†‡‰‹›«»ﬁﬂﬀﬃﬄßæÆœŒøØðÐþÞıłŁ€¢£¤¥¦§¨©ªº¬®¯°±´µ¶·¸×÷¡¿™−ƒ⁄ˆ˜ˇ˘˙˚˛˝\xa0\xad",
    )
)
_DIGITS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789"))
_ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}


def glyph(name: str) -> str | None:
    """The text of a glyph name, by rule where there is one."""
    name = name.split(".")[0] if len(name) > 1 else name
    if len(name) == 1 and name.isalpha():
        return name
    if name in _GLYPHS or name in _DIGITS:
        return _GLYPHS.get(name) or _DIGITS[name]
    if m := re.fullmatch(r"uni([0-9A-F]{4})+|u([0-9A-F]{4,6})", name):
        codes = re.findall("....", name[3:]) if m[1] else [m[2]]
        return "".join(chr(int(c, 16)) for c in codes if int(c, 16) < 0x110000)
    if name[:1].isalpha() and name[1:] in _ACCENTS:
        return unicodedata.normalize("NFC", name[0] + _ACCENTS[name[1:]])
    return None


def base_encoding(name: str | None) -> dict[int, str]:
    return dict(_encoding(name if name in ("WinAnsiEncoding", "PDFDocEncoding", "MacRomanEncoding") else None))


@functools.cache
def _encoding(name: str | None) -> dict[int, str]:
    ascii_half = {i: chr(i) for i in range(32, 127)}
    if name == "WinAnsiEncoding":
        return ascii_half | {i: bytes([i]).decode("cp1252", "ignore") or "•" for i in range(128, 256)}
    if name == "PDFDocEncoding":
        from scriptorium.sources.pdf_objects import text_string

        return {i: text_string(bytes([i])) for i in range(24, 256)}
    if name == "MacRomanEncoding":
        return ascii_half | {i: bytes([i]).decode("mac_roman") for i in range(128, 256)}
    return ascii_half | {0x27: "’", 0x60: "‘"}


#: Private-use bullets of Wingdings-like fonts.
_WINGDINGS = {"": "▪", "": "•", "": "➢", "": "✓", "§": "▪", "ü": "✓", "Ø": "➢", "·": "•"}


def parse_cmap(data: bytes, limits: dict) -> tuple[dict[int, str], int | None]:
    """Code to text, and the codes' length in bytes if it is said."""
    if len(data) > limits["max_cmap_bytes"]:
        raise PdfError("limit-exceeded", "A character map is too large.")
    out: dict[int, str] = {}
    length, stack = None, []
    text = lambda raw: raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")
    reader = Reader(data, 0, limits, references=False)
    while True:
        v = reader.value()
        if isinstance(v, Keyword):
            if v == "":
                break
            if v == "endcodespacerange" and stack and isinstance(stack[-1], bytes):
                length = len(stack[-1])
            elif v == "endbfchar":
                for a, b in zip(stack[::2], stack[1::2]):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        out[int.from_bytes(a, "big")] = text(b)
            elif v == "endbfrange":
                for a, b, c in zip(stack[::3], stack[1::3], stack[2::3]):
                    if not (isinstance(a, bytes) and isinstance(b, bytes)):
                        continue
                    first, last = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    if last - first + len(out) > limits["max_cmap_entries"]:
                        raise PdfError("limit-exceeded", "A character map has too many entries.")
                    for i in range(first, last + 1):
                        if isinstance(c, list):
                            if i - first < len(c) and isinstance(c[i - first], bytes):
                                out[i] = text(c[i - first])
                        elif isinstance(c, bytes) and c:
                            start = text(c)
                            out[i] = start[:-1] + chr(min(0x10FFFF, ord(start[-1]) + i - first))
            if v.startswith(("begin", "end")):
                stack = []
            if len(out) > limits["max_cmap_entries"]:
                raise PdfError("limit-exceeded", "A character map has too many entries.")
        else:
            stack.append(v)
    return out, length


@dataclass
class Font:
    unicode: dict[int, str]
    encoding: dict[int, str]
    widths: dict[int, float]
    default_width: float
    code_bytes: int
    composite: bool
    symbols: bool

    def codes(self, raw: bytes) -> list[int]:
        return [int.from_bytes(raw[i : i + self.code_bytes], "big") for i in range(0, len(raw), self.code_bytes)]

    def decode(self, raw: bytes) -> tuple[str, int]:
        """Text, and how many codes had none (they are U+FFFD)."""
        out, unknown = [], 0
        for code in self.codes(raw):
            t = self.unicode.get(code)
            if t is None and not self.composite:
                t = self.encoding.get(code)
            if t is None:
                t, unknown = "�", unknown + 1
            out.append(_WINGDINGS.get(t, t) if self.symbols else t)
        return "".join(out), unknown

    def advance(self, raw: bytes, size: float, char: float, word: float, scale: float) -> float:
        total = 0.0
        for code in self.codes(raw):
            spaced = word if self.code_bytes == 1 and code == 32 else 0.0
            total += (self.widths.get(code, self.default_width) / 1000 * size + char + spaced) * scale
        return total


def load_font(pdf: Pdf, info: dict, warnings: list, page: int) -> Font:
    kind = str(pdf.get(info.get("Subtype")) or "")
    name = re.sub(r"^[A-Z]{6}\+", "", str(pdf.get(info.get("BaseFont")) or ""))
    unicode, length = {}, None
    stream = pdf.get(info.get("ToUnicode"))
    if isinstance(stream, Stream):
        try:
            unicode, length = parse_cmap(pdf.decoded(stream), pdf.limits)
        except PdfError as e:
            warnings.append(warning("unsupported-feature", f"A font's character map cannot be read: {e}", page))
    symbols = "wingdings" in name.lower()
    if kind == "Type0":
        if str(pdf.get(info.get("Encoding"))) not in ("Identity-H", "Identity-V"):
            warnings.append(warning("unsupported-feature", "A composite font's encoding is taken for Identity.", page))
        if not unicode:
            warnings.append(warning("unknown-glyph", "A composite font has no character map.", page))
        child = pdf.get((pdf.get(info.get("DescendantFonts")) or [None])[0]) or {}
        widths: dict[int, float] = {}
        items = [pdf.get(x) for x in pdf.get(child.get("W")) or []]
        i = 0
        while i + 1 < len(items):
            if isinstance(items[i + 1], list):
                widths |= {items[i] + k: w for k, w in enumerate(map(pdf.get, items[i + 1])) if isinstance(w, (int, float))}
                i += 2
            elif i + 2 < len(items):
                widths |= dict.fromkeys(range(items[i], min(items[i + 1], items[i] + 65_536) + 1), items[i + 2])
                i += 3
            else:
                break
        default = pdf.get(child.get("DW"))
        return Font(unicode, {}, widths, default if isinstance(default, (int, float)) else 1000.0, 2, True, symbols)
    said = pdf.get(info.get("Encoding"))
    base = said.get("BaseEncoding") if isinstance(said, dict) else said
    encoding = base_encoding(str(pdf.get(base)) if base is not None else None)
    if isinstance(said, dict):
        code = 0
        for item in map(pdf.get, pdf.get(said.get("Differences")) or []):
            if isinstance(item, int):
                code = item
            elif isinstance(item, Name):
                if (t := glyph(str(item))) is not None:
                    encoding[code] = t
                code += 1
    first = pdf.get(info.get("FirstChar"))
    widths = {(first or 0) + i: w for i, w in enumerate(map(pdf.get, pdf.get(info.get("Widths")) or [])) if isinstance(w, (int, float))}
    missing = (pdf.get(info.get("FontDescriptor")) or {}).get("MissingWidth")
    return Font(unicode, encoding, widths, float(missing) if isinstance(missing, (int, float)) else 500.0, 1, False, symbols)


class Fonts:
    """A document's fonts, each read once."""

    def __init__(self, pdf: Pdf):
        self.pdf, self.known = pdf, {}

    def of(self, page: Page, warnings: list) -> dict[str, Font]:
        out = {}
        for name, value in (self.pdf.get(page.resources.get("Font")) or {}).items():
            try:
                if value not in self.known if isinstance(value, Ref) else True:
                    info = self.pdf.get(value)
                    if not isinstance(info, dict):
                        continue
                    font = load_font(self.pdf, info, warnings, page.number)
                    if isinstance(value, Ref):
                        self.known[value] = font
                out[name] = self.known[value] if isinstance(value, Ref) else font
            except PdfError as e:
                warnings.append(warning("unsupported-feature", f"Font {name} cannot be read: {e}", page.number))
        return out


# -- content -------------------------------------------------------------------------------------


@dataclass
class Fragment:
    """Shown text in reading space: origin at the top left, y downwards."""

    text: str
    x: float
    y: float
    end_x: float
    size: float
    angle: float
    mcid: int | None
    artifact: bool


@dataclass
class Placement:
    name: str
    matrix: Matrix
    mcid: int | None
    artifact: bool


@dataclass
class _State:
    ctm: Matrix = IDENTITY
    font: str | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0


@dataclass
class Shown:
    fragments: list[Fragment] = field(default_factory=list)
    placements: list[Placement] = field(default_factory=list)


def _turned(box: tuple, rotate: int, x: float, y: float) -> tuple[float, float]:
    """A point of the page in reading space."""
    x0, y0, x1, y1 = box
    return {0: (x - x0, y1 - y), 90: (y - y0, x - x0), 180: (x1 - x, y - y0), 270: (y1 - y, x1 - x)}[rotate]


def interpret(pdf: Pdf, page: Page, fonts: dict[str, Font], warnings: list) -> Shown:
    """Runs a page's content and notes what text it shows where, and which images it places."""
    import math

    data = pdf.content(page)
    reader = Reader(data, 0, pdf.limits, references=False)
    out, now, saved = Shown(), _State(), []
    tm = line = IDENTITY
    marks: list[tuple[str, int | None]] = []
    operands: list = []
    operations, unknown, skipped = 0, 0, set()
    properties = pdf.get(page.resources.get("Properties")) or {}
    number = lambda i: float(operands[i]) if -len(operands) <= i < len(operands) and isinstance(operands[i], (int, float)) else 0.0

    def matrix() -> Matrix:
        return tuple(number(i) for i in range(6))  # type: ignore[return-value]

    def show(raw: bytes) -> None:
        nonlocal tm, unknown
        font = fonts.get(now.font or "")
        if font is None:
            font = Font({}, base_encoding(None), {}, 500.0, 1, False, False)
        text, missed = font.decode(raw)
        unknown += missed
        a = multiply(multiply((now.size * now.scale, 0, 0, now.size, 0, now.rise), tm), now.ctm)
        tm = multiply((1, 0, 0, 1, font.advance(raw, now.size, now.char, now.word, now.scale), 0), tm)
        b = multiply(multiply((now.size * now.scale, 0, 0, now.size, 0, now.rise), tm), now.ctm)
        x, y = _turned(page.media_box, page.rotate, a[4], a[5])
        ex, ey = _turned(page.media_box, page.rotate, b[4], b[5])
        angle = math.degrees(math.atan2(ey - y, ex - x)) if (ex, ey) != (x, y) else 0.0
        mcid = next((m for _, m in reversed(marks) if m is not None), None)
        out.fragments.append(Fragment(text, min(x, ex), y, max(x, ex), math.hypot(a[2], a[3]), angle, mcid, any(t == "Artifact" for t, _ in marks)))

    def next_line(tx: float, ty: float) -> None:
        nonlocal tm, line
        tm = line = multiply((1, 0, 0, 1, tx, ty), line)

    while True:
        v = reader.value()
        if not isinstance(v, Keyword):
            operands.append(v)
            continue
        if v == "":
            break
        operations += 1
        if operations > pdf.limits["max_operations"]:
            raise PdfError("limit-exceeded", f"Page {page.number} has too many operations.")
        match str(v):
            case "q":
                saved.append(_State(**vars(now)))
            case "Q":
                now = saved.pop() if saved else now
            case "cm":
                now.ctm = multiply(matrix(), now.ctm)
            case "BT":
                tm = line = IDENTITY
            case "ET":
                pass
            case "Tf":
                now.font, now.size = str(operands[0]) if operands else None, number(1)
            case "Tc":
                now.char = number(0)
            case "Tw":
                now.word = number(0)
            case "Tz":
                now.scale = number(0) / 100
            case "TL":
                now.leading = number(0)
            case "Ts":
                now.rise = number(0)
            case "Td":
                next_line(number(0), number(1))
            case "TD":
                now.leading = -number(1)
                next_line(number(0), number(1))
            case "Tm":
                tm = line = matrix()
            case "T*":
                next_line(0, -now.leading)
            case "Tj":
                if operands and isinstance(operands[-1], bytes):
                    show(operands[-1])
            case "'" | '"':
                if v == '"':
                    now.word, now.char = number(0), number(1)
                next_line(0, -now.leading)
                if operands and isinstance(operands[-1], bytes):
                    show(operands[-1])
            case "TJ":
                for item in operands[-1] if operands and isinstance(operands[-1], list) else []:
                    if isinstance(item, bytes):
                        show(item)
                    elif isinstance(item, (int, float)):
                        tm = multiply((1, 0, 0, 1, -item / 1000 * now.size * now.scale, 0), tm)
            case "BMC":
                marks.append((str(operands[-1]) if operands else "", None))
            case "BDC":
                given = operands[-1] if operands else None
                given = pdf.get(properties.get(str(given))) if isinstance(given, Name) else given
                mcid = pdf.get(given.get("MCID")) if isinstance(given, dict) else None
                marks.append((str(operands[0]) if operands else "", mcid if isinstance(mcid, int) else None))
            case "EMC":
                if marks:
                    marks.pop()
            case "Do":
                mcid = next((m for _, m in reversed(marks) if m is not None), None)
                out.placements.append(Placement(str(operands[-1]) if operands else "", now.ctm, mcid, any(t == "Artifact" for t, _ in marks)))
            case "BI":
                end = re.compile(rb"[\s]EI(?=[\s]|\Z)").search(data, reader.at)
                reader.at = end.end() if end else len(data)
                skipped.add("BI")
            case _:
                skipped.add(str(v))
        operands = []
    if unknown:
        warnings.append(warning("unknown-glyph", f"{unknown} glyphs of page {page.number} have no known text.", page.number))
    if "BI" in skipped:
        warnings.append(warning("unsupported-image", f"Inline images of page {page.number} are left out.", page.number))
    return out
