"""Page sources and sinks: image files, PDF files through a pluggable renderer, PNG, PDF and JSON output."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "doc_id string, page_number int, height int, width int, n_channels int, data binary, source_path string"

Renderer = Callable[[bytes, int], Iterator[np.ndarray]]
_RENDERER: list[Renderer] = []


def register_renderer(render: Renderer) -> None:
    """render(file's bytes, dpi) yields the pages as BGR or gray arrays; it must be picklable."""
    _RENDERER[:] = [render]


def image_pages(spark: SparkSession, path: str) -> DataFrame:
    """Image files as one-page documents, decoded on the JVM; files that cannot be decoded give no row."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    stem = F.regexp_extract("origin", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return i.select(stem.alias("doc_id"), F.lit(1).alias("page_number"), "height", "width", F.col("nChannels").alias("n_channels"), "data", F.col("origin").alias("source_path"))


def pdf_pages(spark: SparkSession, path: str, dpi: int = 300) -> DataFrame:
    """Pages of PDF files by the registered renderer, streamed one page at a time; an unreadable file gives no rows."""
    if not _RENDERER:
        raise RuntimeError("no PDF renderer is registered")
    render = _RENDERER[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"]):
                stem = path_.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for i, img in enumerate(render(content, dpi)):
                    channels = 1 if img.ndim == 2 else img.shape[2]
                    yield pd.DataFrame([(stem, i + 1, img.shape[0], img.shape[1], channels, np.ascontiguousarray(img).tobytes(), path_)], columns=["doc_id", "page_number", "height", "width", "n_channels", "data", "source_path"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, PAGES)


def pages(spark: SparkSession, paths: list[str], dpi: int = 300) -> DataFrame:
    """Source by suffix: .pdf in any case to the renderer, anything else to the image reader."""
    parts = [pdf_pages(spark, p, dpi) if p.lower().endswith(".pdf") else image_pages(spark, p) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def png(img: np.ndarray, quality: int = 95) -> bytes:
    """PNG bytes of a gray or BGR array; quality 0..100 sets the effort of compression the other way round."""
    rows = img if img.ndim == 2 else np.ascontiguousarray(img[..., ::-1])
    h, w = img.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows.reshape(h, -1)], 1).tobytes()
    level = max(0, min(9, 9 - quality * 9 // 100))

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def pdf(images: list[np.ndarray], dpi: int = 300) -> bytes:
    """A PDF with one image per page, page size in points = pixels x 72 / dpi. No images is an error."""
    return pdf_of([(*i.shape[:2], 1 if i.ndim == 2 else i.shape[2], zlib.compress((i if i.ndim == 2 else np.ascontiguousarray(i[..., ::-1])).tobytes())) for i in images], dpi)


def pdf_of(pages: list[tuple[int, int, int, bytes]], dpi: int = 300) -> bytes:
    """The same from (height, width, channels, compressed rows in gray or RGB)."""
    if not pages:
        raise ValueError("no images")
    parts: list[bytes] = []
    n = len(pages)
    kids = " ".join(f"{3 + 3 * i} 0 R" for i in range(n))
    parts += [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {n} >>".encode()]
    for i, (h, w, channels, body) in enumerate(pages):
        pw, ph = w * 72 / dpi, h * 72 / dpi
        space = "DeviceGray" if channels == 1 else "DeviceRGB"
        draw = f"q {pw:.4f} 0 0 {ph:.4f} 0 0 cm /I Do Q".encode()
        at = 3 + 3 * i
        parts.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {pw:.4f} {ph:.4f}] /Resources << /XObject << /I {at + 2} 0 R >> >> /Contents {at + 1} 0 R >>".encode())
        parts.append(b"<< /Length %d >>\nstream\n" % len(draw) + draw + b"\nendstream")
        parts.append(f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /{space} /BitsPerComponent 8 /Filter /FlateDecode /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for i, p in enumerate(parts, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + p + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(parts) + 1) + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, len(out))


def png_column(images: DataFrame) -> DataFrame:
    """Rows with height, width, n_channels, data to rows with a column ``png``, encoded where the rows are."""
    from pyspark.sql import types as T

    schema = T.StructType([*images.schema.fields, T.StructField("png", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            pdf_["png"] = [None if d is None else png(np.frombuffer(d, np.uint8).reshape((int(h), int(w)) if c == 1 else (int(h), int(w), int(c)))) for d, h, w, c in zip(pdf_["data"], pdf_["height"], pdf_["width"], pdf_["n_channels"])]
            yield pdf_

    return images.mapInPandas(run, schema)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, a folder per value of ``by`` if given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def page_metadata(pages: DataFrame, dpi: int = 300) -> DataFrame:
    """(doc_id, page_number, page_index, width_px, height_px, width_pt, height_pt, rotation): size in points at the
    resolution of rendering; rendered pages are upright."""
    pt = lambda c: F.col(c) * F.lit(72.0) / F.lit(float(dpi))
    return pages.select("doc_id", "page_number", (F.col("page_number") - 1).alias("page_index"), F.col("width").alias("width_px"), F.col("height").alias("height_px"), pt("width").alias("width_pt"), pt("height").alias("height_pt"), F.lit(0).alias("rotation"))


_BOX = re.compile(rb"/MediaBox\s*\[\s*(-?[\d.]+)\s+(-?[\d.]+)\s+(-?[\d.]+)\s+(-?[\d.]+)\s*\]")
_TURN = re.compile(rb"/Rotate\s+(-?\d+)")
_PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")


def pdf_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, page_number, page_index, width_pt, height_pt, rotation) of PDF files whose page objects are plain,
    read without a renderer. A page without a box of its own has that of the one before; other files give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            rows = []
            for path_, content in zip(pdf_["path"], pdf_["content"]):
                size, n = (None, None), 0
                for part in content.split(b"endobj"):
                    if box := _BOX.search(part):
                        x0, y0, x1, y1 = map(float, box.groups())
                        size = x1 - x0, y1 - y0
                    if _PAGE.search(part):
                        turn = _TURN.search(part)
                        rows.append((path_, n + 1, n, *size, int(turn[1]) % 360 if turn else 0))
                        n += 1
            yield pd.DataFrame(rows, columns=["source_path", "page_number", "page_index", "width_pt", "height_pt", "rotation"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source_path string, page_number int, page_index int, width_pt double, height_pt double, rotation int")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_json`` wrote, with the schema of the result (``RESULTS`` has those of the phases)."""
    return spark.read.schema(schema).json(path)


_BBOX = "bbox struct<x:int,y:int,width:int,height:int>"
RESULTS = {
    "assessment": "doc_id string, page_number int, dpi double, dpi_ok boolean, blur_score double, is_blurry boolean, noise_score double, is_noisy boolean, contrast_score double, is_low_contrast boolean, skew_angle double, needs_deskew boolean, quality string, enhancement_needed boolean, width_px int, height_px int",
    "layout": f"doc_id string, page_number int, ordinal int, parent_ordinal int, type string, {_BBOX}, region_id string, parent_region_id string, depth int",
    "manifest": f"doc_id string, page_number int, region_id string, parent_region_id string, depth int, ordinal int, type string, {_BBOX}, image_path string, has_image boolean",
    "ocr_result": "doc_id string, region_id string, word_idx int, text string, confidence double, bbox struct<x1:int,y1:int,x2:int,y2:int>, error string",
}


def xlsx(rows: list[list]) -> bytes:
    """A workbook with one sheet of texts and numbers; null cells are left out."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind, pack = "application/vnd.openxmlformats-officedocument.spreadsheetml", "http://schemas.openxmlformats.org/package/2006"
    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def workbooks(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, xlsx): the rows of each key, a document's tables say, as one workbook, with a line of column names."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        body = [[None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r] for r in own[columns].itertuples(index=False)]
        return pd.DataFrame({key: [own[key].iloc[0]], "xlsx": [xlsx([columns, *body])]})

    return rows.groupBy(key).applyInPandas(run, f"{key} string, xlsx binary")
