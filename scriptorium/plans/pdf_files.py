"""Small PDF files made byte by byte, to be read back: what the registered file queries read."""

from __future__ import annotations

import struct
import zlib


def stream(data: bytes, info: bytes = b"", packed: bool = True, columns: int = 0) -> bytes:
    """A stream object; columns: rows of so many bytes go through the Up predictor."""
    if columns:
        rows, above, out = [data[i : i + columns].ljust(columns) for i in range(0, len(data), columns)], bytes(columns), b""
        for row in rows:
            out += b"\2" + bytes((a - b) % 256 for a, b in zip(row, above))
            above = row
        data, info = out, info + b" /DecodeParms << /Predictor 12 /Columns %d >>" % columns
    if packed:
        data, info = zlib.compress(data), info + b" /Filter /FlateDecode"
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), info, data)


def plain(objects: dict[int, bytes], trailer: bytes = b"") -> bytes:
    """A file with a cross-reference table; object 1 is the root."""
    out, at = b"%PDF-1.7\n", {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    size = max(objects) + 1
    table = b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(1, size))
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (size, table, size, trailer, len(out))


def compressed(objects: dict[int, bytes], trailer: bytes = b"") -> bytes:
    """A file whose plain objects lie in an object stream, and whose cross-references are a predicted stream."""
    inner = {n: b for n, b in objects.items() if b"\nstream\n" not in b}
    holder, table_at = max(objects) + 1, max(objects) + 2
    head, body, place = b"", b"", {}
    for i, (n, b) in enumerate(inner.items()):
        head += b"%d %d " % (n, len(body))
        body += b + b" "
        place[n] = (2, holder, i)
    out = b"%PDF-1.5\n"
    for n, b in objects.items():
        if n not in inner:
            place[n] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    place[holder] = (1, len(out), 0)
    out += b"%d 0 obj\n%s\nendobj\n" % (holder, stream(head + body, b"/Type /ObjStm /N %d /First %d" % (len(inner), len(head))))
    place[table_at] = (1, len(out), 0)
    rows = b"".join(struct.pack(">BIB", *place.get(n, (0, 0, 0))) for n in range(table_at + 1))
    info = b"/Type /XRef /Size %d /W [1 4 1] /Root 1 0 R %s" % (table_at + 1, trailer)
    return out + b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (table_at, stream(rows, info, columns=6), place[table_at][1])


def literal(text: str) -> bytes:
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


_HELVETICA = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [%s] >>" % (b"500 " * 95)


def page_file(content: bytes, info: dict[str, str] | None = None) -> bytes:
    """One page of 400 by 400 with one font, F1, in which every character is half as wide as it is high."""
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 400 400] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", 4: stream(content), 5: _HELVETICA,
    }
    if info:
        objects[6] = b"<< %s >>" % b" ".join(b"/%s %s" % (k.encode(), literal(v)) for k, v in info.items())
    return plain(objects, b"/Info 6 0 R" if info else b"")


def lines_at(lines: list[tuple[float, float, float, str]]) -> bytes:
    """Content that shows (x, y, size, text)."""
    return b" ".join(b"BT /F1 %g Tf %g %g Td %s Tj ET" % (size, x, y, literal(text)) for x, y, size, text in lines)


def updated(first: bytes, number: int, body: bytes) -> bytes:
    """A file with one object in a newer section that points back to the older one."""
    start, at = int(first.rsplit(b"startxref\n", 1)[1].split()[0]), len(first) + 1
    out = first + b"\n%d 0 obj\n%s\nendobj\n" % (number, body)
    return out + b"xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Size %d /Root 1 0 R /Info %d 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (number, at, number + 1, number, start, len(out))


def composite_file(text: str) -> bytes:
    """Text in a composite font: codes from 1 on, told apart by its own map; half as wide as high."""
    letters = sorted(set(text))
    codes = {c: i + 1 for i, c in enumerate(letters)}
    pairs = b"".join(b"<%04X> <%s>\n" % (codes[c], c.encode("utf-16-be").hex().upper().encode()) for c in letters)
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange %d beginbfchar\n%sendbfchar endcmap" % (len(letters), pairs)
    shown = b"".join(b"%04X" % codes[c] for c in text)
    return compressed({
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 400 400] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        4: stream(b"BT /F1 10 Tf 20 300 Td <%s> Tj ET" % shown), 5: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 7 0 R /DescendantFonts [6 0 R] >>",
        6: b"<< /Type /Font /Subtype /CIDFontType2 /DW 900 /W [0 %d 500] >>" % len(letters), 7: stream(cmap),
    })


def tagged_file(title: str, region: str, key: int, links: str) -> bytes:
    """A tagged file: heading, paragraph with a link, list, table, figure with an image, outline; all compressed."""
    texts = [title, f"{title} lies in", region, "1.", f"first of {title}", "2.", f"second of {title}", "Name", "Key", title, str(key), f"The flag of {title}"]
    marks = b" ".join(b"/Span << /MCID %d >> BDC BT /F1 10 Tf %d %d Td %s Tj ET EMC" % (i, 20 + (i in (2, 4, 6, 8, 10)) * 150, 380 - 25 * i, literal(t)) for i, t in enumerate(texts))
    marks += b" /Figure << /MCID 12 >> BDC q 20 0 0 10 %d 30 cm /I1 Do Q EMC" % (100 + key)
    e = lambda role, kids, more=b"": b"<< /S /%s /K %s /Pg 3 0 R %s >>" % (role, kids, more)
    pixel = bytes([key % 256, len(title) % 256, 7])
    return compressed({
        1: b"<< /Type /Catalog /Pages 2 0 R /StructTreeRoot 10 0 R /Outlines 30 0 R /Dests << /top [3 0 R /Fit] >> >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 400 400] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /I1 40 0 R >> >> >>", 4: stream(marks), 5: _HELVETICA,
        10: b"<< /RoleMap << /Headline /H1 >> /K [11 0 R 12 0 R 14 0 R 19 0 R 27 0 R] >>", 11: e(b"Headline", b"0"), 12: e(b"P", b"[1 13 0 R]"), 13: e(b"Link", b"[2 << /Type /OBJR /Obj 35 0 R >>]"),
        14: e(b"L", b"[15 0 R 17 0 R]"), 15: e(b"LI", b"[16 0 R 41 0 R]"), 16: e(b"Lbl", b"3"), 41: e(b"LBody", b"4"), 17: e(b"LI", b"[18 0 R 42 0 R]"), 18: e(b"Lbl", b"5"), 42: e(b"LBody", b"6"),
        19: e(b"Table", b"[20 0 R 23 0 R]"), 20: e(b"TR", b"[21 0 R 22 0 R]"), 21: e(b"TH", b"7"), 22: e(b"TH", b"8"), 23: e(b"TR", b"[24 0 R 25 0 R]"), 24: e(b"TD", b"9"), 25: e(b"TD", b"10"),
        27: e(b"Figure", b"[12 28 0 R]", b"/Alt %s" % literal(f"Flag of {title}")), 28: e(b"Caption", b"11"),
        30: b"<< /First 31 0 R >>", 31: b"<< /Title %s /Dest /top /First 32 0 R >>" % literal(title), 32: b"<< /Title %s /A << /S /URI /URI %s >> >>" % (literal(region), literal(links)),
        35: b"<< /Subtype /Link /A << /S /URI /URI %s >> >>" % literal(links), 40: stream(pixel * 6, b"/Subtype /Image /Width 3 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB", columns=9),
    })
