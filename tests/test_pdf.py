"""PDF files made byte by byte: syntax, text, layout, tags, images, damage."""

import json
import struct
import zlib

import numpy as np
import pytest

from scriptorium.sources import pdf as P
from scriptorium.sources import pdf_layout as G
from scriptorium.sources.pdf_objects import Name, Pdf, PdfError, Reader, Ref, Stream, inflate, text_string, unpredict
from scriptorium.sources.pdf_structure import slug
from scriptorium.sources.pdf_text import Fragment, glyph, parse_cmap


def file(objects: dict[int, bytes], root: int = 1, more: bytes = b"", head: bytes = b"%PDF-1.7\n") -> bytes:
    out, at = head, {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    out += b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(1, size))
    return out + b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (size, root, more, start)


def stream(data: bytes, info: bytes = b"", pack: bool = False) -> bytes:
    if pack:
        data, info = zlib.compress(data), info + b" /Filter /FlateDecode"
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), info, data)


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /uni0416] >> /FirstChar 32 /Widths [250 %s] >>" % (b"500 " * 94)


def simple(content: bytes, pack: bool = True, page: bytes = b"", **objects) -> bytes:
    return file({
        1: b"<< /Type /Catalog /Pages 2 0 R %s >>" % objects.pop("catalog", b""),
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> %s >> %s >>" % (objects.pop("resources", b""), page),
        4: stream(content, pack=pack), 5: FONT, 6: b"<< /Title (A \\(title\\)) /Producer <FEFF0050> >>",
        **{int(k[1:]): v for k, v in objects.items()},
    }, more=b"/Info 6 0 R")


def test_values():
    r = Reader(b"<< /A#20b [1 -2.5 .5 true null (a\\(b\\)\\101\\\n(in)) <48 4> 3 0 R] % note\n /C /D >> 7 0 obj")
    assert r.value() == {"A b": [1, -2.5, 0.5, True, None, b"a(b)A(in)", b"H@", Ref(3, 0)], "C": Name("D")}
    assert [r.value(), r.value(), r.value()] == [7, 0, "obj"]
    with pytest.raises(PdfError):
        Reader(b"[" * 100).value()
    assert text_string(b"\xfe\xff\x00A\x00\x00") == "A" and text_string(b"\x80x") == "•x" and slug("Éa  b!") == "ea-b"


def test_filters():
    assert inflate(zlib.compress(b"abc" * 9), 1000, 300) == b"abc" * 9
    for limit, ratio in ((100, 300), (1 << 20, 5)):
        with pytest.raises(PdfError):
            inflate(zlib.compress(b"0" * 100_000), limit, ratio)
    rng = np.random.Generator(np.random.PCG64(0))
    rows = rng.integers(0, 256, (6, 12), dtype=np.uint8)
    out, above = b"", np.zeros(12, int)
    for i, row in enumerate(rows.astype(int)):
        left, corner = np.r_[np.zeros(3, int), row[:-3]], np.r_[np.zeros(3, int), above[:-3]]
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * row, left, above, (left + above) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))][i % 5]
        out += bytes([i % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    assert unpredict(out, {"Predictor": 15, "Colors": 3, "Columns": 4}) == rows.tobytes()
    assert unpredict(b"\x01\x01\x01\x05\x01\x01", {"Predictor": 2, "Columns": 3}) == b"\x01\x02\x03\x05\x06\x07"


def test_cross_reference_stream_and_object_stream():
    packed = b"1 0 2 40 " .ljust(10) + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(40) + b"<< /Type /Pages /Kids [] /Count 0 >>"
    body = b"%PDF-1.5\n"
    at = len(body)
    body += b"5 0 obj\n" + stream(packed, b"/Type /ObjStm /N 2 /First 10", pack=True) + b"\nendobj\n"
    where = len(body)
    table = b"".join(struct.pack(">BHB", *x) for x in [(0, 0, 0), (2, 5, 0), (2, 5, 1), (0, 0, 0), (0, 0, 0), (1, at, 0), (1, where, 0)])
    body += b"6 0 obj\n" + stream(table, b"/Type /XRef /Size 7 /W [1 2 1] /Root 1 0 R", pack=True) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % where
    assert Pdf(body).root["Type"] == "Catalog" and P.parse(body)["metadata"]["pageCount"] == 0


def test_newest_section_wins():
    old = simple(b"")
    start = int(old.rsplit(b"startxref\n", 1)[1].split()[0])
    at = len(old)
    new = old + b"\n6 0 obj\n<< /Title (New) >>\nendobj\n"
    where = len(new)
    new += b"xref\n6 1\n%010d 00000 n \ntrailer\n<< /Size 7 /Root 1 0 R /Info 6 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at + 1, start, where)
    assert P.parse(new)["metadata"]["title"] == "New"


@pytest.mark.parametrize(
    "data, code",
    [(b"", "invalid-header"), (b"%PDF-1.4 nothing", "corrupt-structure"), (simple(b"").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 6 0 R"), "unsupported-encryption"), (simple(b"").replace(b"startxref\n", b"startxref\n9"), "corrupt-structure")],
)
def test_fatal(data, code):
    with pytest.raises(PdfError) as e:
        P.parse(data)
    assert e.value.code == code


def test_text():
    doc = P.parse(simple(b"BT /F1 20 Tf 10 80 Td (large line) Tj ET BT /F1 10 Tf 10 60 Td [(Some) -300 (body A)] TJ 0 -12 Td (text B) Tj 0 -12 Td (goes on) Tj ET /Artifact BMC BT /F1 8 Tf 10 5 Td (foot) Tj ET EMC"))
    assert doc["metadata"] == {"pageCount": 1, "title": "A (title)", "producer": "P"}
    assert [(b["type"], b["text"][0]["text"]) for b in doc["pages"][0]["blocks"]] == [("heading", "large line"), ("paragraph", "Some body é text Ж goes on")]
    assert doc["pages"][0]["blocks"][0]["level"] == 1 and doc["pages"][0]["width"] == 200
    turned = P.parse(simple(b"BT /F1 10 Tf 0 1 -1 0 50 20 Tm (up) Tj ET", page=b"/Rotate 90"))["pages"][0]
    assert (turned["width"], turned["height"], turned["blocks"][0]["text"][0]["text"]) == (100, 200, "up")


def test_composite_font():
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00480069> endbfchar 2 beginbfrange <0002> <0004> <0061> <0005> <0006> [<0078> <0079>] endbfrange"
    assert parse_cmap(cmap, Pdf(simple(b"")).limits) == ({1: "Hi", 2: "a", 3: "b", 4: "c", 5: "x", 6: "y"}, 2)
    doc = P.parse(simple(
        b"BT /F2 10 Tf 10 50 Td <000100030006> Tj <0009> Tj ET", resources=b"", o7=b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 8 0 R /DescendantFonts [<< /DW 600 /W [1 [400 500] 3 6 700] >>] >>", o8=stream(cmap, pack=True),
    ).replace(b"/F1 5 0 R", b"/F2 7 0 R"))
    assert doc["pages"][0]["blocks"][0]["text"][0]["text"] == "Hiby�" and any(w["code"] == "unknown-glyph" for w in doc["pages"][0]["warnings"])
    assert glyph("Odieresis") == "Ö" and glyph("one") == "1" and glyph("quotedblleft") == "“" and glyph("nonsense") is None


TAGGED = b"""/P << /MCID 0 >> BDC BT /F1 12 Tf 10 90 Td (Heading) Tj ET EMC /P << /MCID 1 >> BDC BT /F1 10 Tf 10 75 Td (See) Tj ET EMC /Span << /MCID 2 >> BDC BT /F1 10 Tf 40 75 Td (site) Tj ET EMC
/P << /MCID 3 >> BDC BT /F1 10 Tf 10 60 Td (1.) Tj ET EMC /P << /MCID 4 >> BDC BT /F1 10 Tf 25 60 Td (First) Tj ET EMC /P << /MCID 5 >> BDC BT /F1 10 Tf 10 45 Td (Tool) Tj ET EMC /P << /MCID 6 >> BDC BT /F1 10 Tf 10 30 Td (Wrench) Tj ET EMC
/Figure << /MCID 7 >> BDC q 20 0 0 10 150 5 cm /I1 Do Q EMC /P << /MCID 8 >> BDC BT /F1 10 Tf 10 10 Td (Caption) Tj ET EMC BT /F1 10 Tf 100 10 Td (loose) Tj ET"""


def tagged() -> bytes:
    e = lambda role, kids, more=b"": b"<< /S /%s /K %s /Pg 3 0 R %s >>" % (role, kids, more)
    pixels = bytes(range(12))
    return simple(
        TAGGED, catalog=b"/StructTreeRoot 10 0 R /Outlines 30 0 R /Dests << /here [3 0 R /Fit] >>", resources=b"/XObject << /I1 40 0 R >>",
        o10=b"<< /RoleMap << /Title /H1 >> /K [11 0 R 12 0 R 14 0 R 17 0 R 22 0 R] >>", o11=e(b"Title", b"0"), o12=e(b"P", b"[1 13 0 R]"), o13=e(b"Link", b"[2 << /Type /OBJR /Obj 35 0 R >>]"),
        o14=e(b"L", b"[15 0 R]"), o15=e(b"LI", b"[16 0 R 26 0 R]"), o16=e(b"Lbl", b"3"), o26=e(b"LBody", b"4"), o17=e(b"Table", b"[18 0 R 20 0 R]"), o18=e(b"TR", b"[19 0 R]"), o19=e(b"TH", b"5"),
        o20=e(b"TR", b"[21 0 R]"), o21=e(b"TD", b"6", b"/A << /O /Table /ColSpan 2 >>"), o22=e(b"Figure", b"[7 23 0 R]", b"/Alt (An image)"), o23=e(b"Caption", b"8"),
        o30=b"<< /First 31 0 R >>", o31=b"<< /Title (Chapter) /Dest /here /First 32 0 R >>", o32=b"<< /Title (Inner) /A << /S /URI /URI (javascript:x) >> /Next 31 0 R >>",
        o35=b"<< /Subtype /Link /A << /S /URI /URI (https://x.example) >> >>", o40=stream(pixels, b"/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB", pack=True),
    )


def test_tagged():
    doc = P.parse(tagged())
    heading, paragraph, items, table, figure, loose = doc["pages"][0]["blocks"]
    assert (heading["type"], heading["level"], heading["text"][0]["text"]) == ("heading", 1, "Heading")
    assert paragraph["text"] == [{"text": "See"}, {"text": " "}, {"text": "site", "link": {"kind": "external", "href": "https://x.example"}}]
    assert items["ordered"] and items["items"][0]["blocks"][0]["text"] == [{"text": "1. "}, {"text": "First"}]
    cells = [c for r in table["rows"] for c in r["cells"]]
    assert [(c["id"], c["isHeader"], c["colSpan"]) for c in cells] == [("th-1", True, 1), ("td-1", False, 2)]
    assert figure["imageId"] == "img-1" and figure["altText"] == "An image" and figure["caption"][0]["text"] == "Caption"
    assert loose["text"][0]["text"] == "loose"
    assert doc["outline"] == [{"title": "Chapter", "level": 1, "children": [{"title": "Inner", "level": 2, "children": []}], "target": {"kind": "internal", "pageNumber": 1}}]
    [image] = doc["assets"]
    assert image["bytes"].startswith(b"\x89PNG") and image["placements"][0]["x"] == 150 and image["placements"][0]["y"] == 85 and image["mimeType"] == "image/png"
    raw = zlib.decompress(image["bytes"][image["bytes"].index(b"IDAT") + 4 : image["bytes"].index(b"IEND") - 8])
    assert raw == b"\0" + bytes([0, 1, 2, 255, 3, 4, 5, 255]) + b"\0" + bytes([6, 7, 8, 255, 9, 10, 11, 255])


def fragment(text, x, y, width=20.0, size=10.0, angle=0.0):
    return Fragment(text, x, y, x + width, size, angle, None, False)


def test_layout():
    found = G.lines([fragment("world", 32, 20.5), fragment("Hello", 10, 20), fragment("far", 120, 20), fragment("next", 10, 32), fragment("up", 5, 50, angle=90), fragment("", 0, 0)])
    assert [(x.text, x.level) for x in found] == [("Hello world", True), ("far", True), ("next", True), ("up", False)]
    lines = [G.Line("t", y, x, 50, s, True) for y, x, s in [(10, 10, 10), (22, 10, 10), (34, 10, 10), (60, 10, 10), (72, 30, 10), (84, 30, 14)]]
    assert [len(p) for p in G.paragraphs(lines)] == [3, 1, 1, 1]
    assert G.body_size(G.paragraphs(lines)) == 10 and G.body_size([]) == 12 and [G.heading_level(r) for r in (1.9, 1.5, 1.3, 1.0)] == [1, 2, 3, None]
    drift = G.rows([fragment("a", i * 30, 10 + i * 2.0) for i in range(4)])
    assert [len(r) for r in drift] == [2, 2]


def test_source(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(tagged())
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 broken")
    rows = {r.original_filename: r for r in P.read(spark, str(tmp_path)).collect()}
    assert rows["bad.pdf"].error_code == "corrupt-structure" and rows["bad.pdf"].semantic is None
    doc = json.loads(rows["good.pdf"].semantic)
    assert rows["good.pdf"].assets[0].id == "img-1" and doc["pages"][0]["blocks"][0]["type"] == "heading"
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = P.fragments(files)
    assert found.count() == 9 and P.body_sizes(found).first().body_size == 10


def test_missing_end_is_found():
    data = simple(b"BT /F1 10 Tf 10 50 Td (x) Tj ET", pack=False)
    assert P.parse(data.replace(b"/Length 31", b"/Length 99"))["pages"][0]["blocks"][0]["text"][0]["text"] == "x"
    assert isinstance(Pdf(data).get(Ref(4, 0)), Stream)


@pytest.mark.parametrize("said", ["[]", "[ 1 -2\n+3 ]", "[12 0 R 7]", "[1 2.5 3]", "[1 [2 3] 4]", "[1 %x\n2]", "[1 2", "[500 500 /A]"])
def test_arrays_of_integers_read_as_any_others(said, monkeypatch):
    from scriptorium.sources import pdf_objects

    quick = Reader(said.encode() + b" /Next").value(), Reader(said.encode()).value()
    monkeypatch.setattr(pdf_objects, "_INTEGERS", pdf_objects.re.compile(rb"(?!)"))
    assert quick == (Reader(said.encode() + b" /Next").value(), Reader(said.encode()).value())


def test_arrays_of_integers_keep_the_nesting_limit():
    deep = b"[" * 300 + b"1" + b"]" * 300
    with pytest.raises(PdfError):
        Reader(deep).value()


@pytest.mark.parametrize("name, table, rows", [("pdf_metadata", "part", 4500), ("pdf_fonts", "customer", 4100)])
def test_one_split_of_many_rows_is_read_by_many_tasks(spark, tmp_path, name, table, rows):
    """A small table of many rows is one split: its files are dealt out before they are made."""
    from scriptorium.plans import pdf_queries

    key, said = {"part": ("p_partkey", "p_name"), "customer": ("c_custkey", "c_name")}[table]
    spark.range(rows).selectExpr(f"id {key}", f"concat('n', id) {said}").coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    read = pdf_queries.QUERIES[name](spark, str(tmp_path))
    assert read.rdd.getNumPartitions() == 3
    assert read.select("document_id").distinct().count() == rows
