"""PDF files as a source: bytes to semantic documents, images and errors, one file a row."""

from __future__ import annotations

import json
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.pdf_objects import Page, Pdf, PdfError, Ref, Stream, text_string, warning
from scriptorium.sources.pdf_structure import Element, Ids, Targets, outline, page_blocks, structure
from scriptorium.sources.pdf_text import Fonts, Placement, Shown, interpret

# -- images --------------------------------------------------------------------------------------


def png(width: int, height: int, rgba: bytes) -> bytes:
    """An RGBA image of 8 bits a channel, without row filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(rgba, np.uint8).reshape(height, width * 4)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


class Images:
    """A document's images, each made once however often it is placed."""

    def __init__(self, pdf: Pdf):
        self.pdf, self.made = pdf, {}

    def place(self, page: Page, placements: list[Placement], warnings: list) -> dict[int, list[str]]:
        """Image ids by marked-content id."""
        out: dict[int, list[str]] = {}
        objects = self.pdf.get(page.resources.get("XObject")) or {}
        for p in placements:
            value = objects.get(p.name)
            stream = self.pdf.get(value)
            if not isinstance(stream, Stream) or self.pdf.get(stream.info.get("Subtype")) != "Image":
                continue
            key = value if isinstance(value, Ref) else (page.number, p.name)
            if key not in self.made:
                try:
                    self.made[key] = {"id": f"img-{len(self.made) + 1}", "pageNumber": page.number, "placements": [], **self.asset(stream)}
                except PdfError as e:
                    self.made[key] = None
                    warnings.append(warning("unsupported-image", f"Image {p.name} was left out: {e}", page.number))
            made = self.made[key]
            if made:
                x0, y0, x1, y1 = page.media_box
                a, b, c, d, e, f = p.matrix
                xs, ys = [e, e + a, e + c, e + a + c], [f, f + b, f + d, f + b + d]
                made["placements"].append({"pageNumber": page.number, "x": min(xs) - x0, "y": y1 - max(ys), "width": max(xs) - min(xs), "height": max(ys) - min(ys), "matrix": list(p.matrix), "xObjectName": p.name})
                if p.mcid is not None:
                    out.setdefault(p.mcid, []).append(made["id"])
        return out

    def asset(self, stream: Stream) -> dict:
        width, height = self.pdf.get(stream.info.get("Width")), self.pdf.get(stream.info.get("Height"))
        limits = self.pdf.limits
        if not (isinstance(width, int) and isinstance(height, int) and 0 < width <= limits["max_image_side"] and 0 < height <= limits["max_image_side"] and width * height <= limits["max_image_pixels"]):
            raise PdfError("limit-exceeded", "its size is out of bounds")
        names = [n for n, _ in self.pdf.filters(stream)]
        if names == ["DCTDecode"]:
            if not stream.raw.startswith(b"\xff\xd8"):
                raise PdfError("corrupt-structure", "it is not a JPEG")
            return {"width": width, "height": height, "mimeType": "image/jpeg", "bytes": stream.raw}
        rgb = self.pixels(stream, width, height)
        alpha = np.full((height, width, 1), 255, np.uint8)
        mask = self.pdf.get(stream.info.get("SMask"))
        if isinstance(mask, Stream) and self.pdf.get(mask.info.get("Width")) == width and self.pdf.get(mask.info.get("Height")) == height:
            alpha = self.pixels(mask, width, height)[:, :, :1]
        return {"width": width, "height": height, "mimeType": "image/png", "bytes": png(width, height, np.concatenate([rgb, alpha], axis=2).tobytes())}

    def pixels(self, stream: Stream, width: int, height: int) -> np.ndarray:
        space = self.pdf.get(stream.info.get("ColorSpace"))
        if isinstance(space, list) and space and self.pdf.get(space[0]) == "ICCBased":
            profile = self.pdf.get(space[1])
            channels = self.pdf.get(profile.info.get("N")) if isinstance(profile, Stream) else None
        else:
            channels = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3}.get(str(space[0] if isinstance(space, list) and space else space))
        if self.pdf.get(stream.info.get("BitsPerComponent")) != 8 or channels not in (1, 3):
            raise PdfError("unsupported-feature", "its colours are not 8-bit gray or RGB")
        data = self.pdf.decoded(stream)
        if len(data) < width * height * channels:
            raise PdfError("corrupt-structure", "it is too short")
        return np.broadcast_to(np.frombuffer(data, np.uint8, width * height * channels).reshape(height, width, channels), (height, width, 3))


# -- documents -----------------------------------------------------------------------------------


def read_page(pdf: Pdf, page: Page, fonts: Fonts, warnings: list) -> Shown:
    return interpret(pdf, page, fonts.of(page, warnings), warnings)


def parse(data: bytes, limits: dict | None = None, images: bool = True) -> dict:
    """The semantic document of a PDF file; PdfError where the file cannot be read."""
    timings, last = [], time.perf_counter()

    def done(phase: str, page: int | None = None) -> None:
        nonlocal last
        now = time.perf_counter()
        timings.append({"phase": phase, "durationMs": (now - last) * 1000} | ({"pageNumber": page} if page else {}))
        last = now

    began = last
    pdf = Pdf(data, limits)
    done("xref-object-resolution")
    pages = pdf.pages()
    done("page-tree")
    numbers = {p.ref: p.number for p in pages if p.ref}
    elements, targets, ids, fonts, pictures = structure(pdf, numbers), Targets(pdf, numbers), Ids(), Fonts(pdf), Images(pdf)
    done("structure-reconstruction")

    def link_of(e: Element) -> dict | None:
        for kid in e.kids:
            info = pdf.get(kid[2]) if not isinstance(kid, Element) and kid[0] == "object" else None
            if isinstance(info, dict) and (target := targets.of(info)):
                return target
        return None

    out = []
    for page in pages:
        warnings: list[dict] = []
        shown = read_page(pdf, page, fonts, warnings)
        done("page-content-interpret", page.number)
        placed = pictures.place(page, [p for p in shown.placements if not p.artifact], warnings) if images else {}
        done("image-extraction", page.number)
        blocks = page_blocks(page, elements, shown.fragments, placed, ids, link_of, warnings)
        done("structure-reconstruction", page.number)
        x0, y0, x1, y1 = page.media_box
        size = (x1 - x0, y1 - y0) if page.rotate % 180 == 0 else (y1 - y0, x1 - x0)
        out.append({"pageNumber": page.number, "width": size[0], "height": size[1], "blocks": blocks, "warnings": warnings})
    info = pdf.get(pdf.trailer.get("Info"))
    info = info if isinstance(info, dict) else {}
    meta = {"pageCount": len(pages)} | {k: v for k, v in (("title", text_string(pdf.get(info.get("Title")))), ("producer", text_string(pdf.get(info.get("Producer"))))) if v}
    assets = [a for a in pictures.made.values() if a]
    return {"metadata": meta, "pages": out, "outline": outline(pdf, targets), "assets": assets, "warnings": pdf.warnings, "timings": {"totalMs": (time.perf_counter() - began) * 1000, "phases": timings, "inputBytes": len(data)}}


def portable(document: dict) -> str:
    """A document as JSON, its images without bytes (they are rows of their own)."""
    return json.dumps(document | {"assets": [{k: v for k, v in a.items() if k != "bytes"} for a in document["assets"]]})


#: A result batch is sent on at so many rows, or so many characters and bytes of them.
BATCH_ROWS, BATCH_BYTES = 500, 1 << 20

ROW = "path string, original_filename string, content_sha256 string, semantic string, assets array<struct<id: string, mime_type: string, width: int, height: int, content: binary>>, error_code string, error_detail string"


def documents(files: DataFrame, limits: dict | None = None, images: bool = True) -> DataFrame:
    """ROW for each file (path, content): a file that cannot be read has an error instead of a document.

    files may be a table or a stream of the binaryFile source. One bad file never fails the job.
    """
    import hashlib

    form = pa.schema([(n, pa.string()) for n in ("path", "original_filename", "content_sha256", "semantic")]
                     + [("assets", pa.list_(pa.struct([("id", pa.string()), ("mime_type", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary())])))]
                     + [("error_code", pa.string()), ("error_detail", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):  # one file at a time is a Python object
                path, data = path.as_py(), data.as_py() or b""
                row = {"path": path, "original_filename": (path or "").rsplit("/", 1)[-1], "content_sha256": hashlib.sha256(data).hexdigest(), "semantic": None, "assets": [], "error_code": None, "error_detail": None}
                try:
                    document = parse(data, limits, images)
                    row["semantic"] = portable(document)
                    row["assets"] = [{"id": a["id"], "mime_type": a["mimeType"], "width": a["width"], "height": a["height"], "content": a["bytes"]} for a in document["assets"]]
                except PdfError as e:
                    row |= {"error_code": e.code, "error_detail": str(e)}
                except Exception as e:  # a damaged file can break any assumption
                    row |= {"error_code": "internal-error", "error_detail": f"{type(e).__name__}: {e}"}
                rows.append(row)
                held += len(row["semantic"] or "") + sum(len(a["content"]) for a in row["assets"])
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, form)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, form)

    return files.select("path", "content").mapInArrow(run, ROW)


def read(spark: SparkSession, folder: str, pattern: str = "*.pdf", **how) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return documents(files, **how)


def fragments(files: DataFrame) -> DataFrame:
    """Positioned text of all pages: path, page_number, ordinal, text, x, y, end_x, size, angle, mcid, artifact."""
    schema = "path string, page_number int, ordinal int, text string, x double, y double, end_x double, size double, angle double, mcid int, artifact boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5, pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, form = [], pa.schema(list(zip(names, kinds)))
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):
                path, found = path.as_py(), []
                try:
                    pdf = Pdf(data.as_py() or b"")
                    fonts = Fonts(pdf)
                    for page in pdf.pages():
                        found += [{"path": path, "page_number": page.number, "ordinal": i, **vars(f)} for i, f in enumerate(read_page(pdf, page, fonts, []).fragments)]
                except PdfError:
                    continue
                rows += found
                if len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, form)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, form)

    return files.select("path", "content").mapInArrow(run, schema)


def body_sizes(found: DataFrame) -> DataFrame:
    """path, page_number, body_size: the upper median of a page's text sizes."""
    sizes = F.sort_array(F.collect_list("size"))
    return found.where("not artifact").groupBy("path", "page_number").agg(F.element_at(sizes, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("body_size"))
