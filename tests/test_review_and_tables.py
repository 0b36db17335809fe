import io
import re
import sys
import types
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.functions import bbox as B
from quirework.functions import image as I
from quirework.operators import hashing, knowledge, layout, ocr
from quirework.plans import pipeline
from quirework.sources import images
from quirework.streaming import feedback

BOXES = "doc_id string, region_id string, type string, page_number int, bbox struct<x:int,y:int,width:int,height:int>, area int"


def boxes(spark):
    rows = [("d", "a", "table", 1, (0, 0, 100, 50), 9), ("d", "b", "paragraph", 1, (90, 40, 50, 50), 9), ("d", "c", "paragraph", 1, (100, 50, 10, 10), 9), ("d", "e", "paragraph", 2, (0, 0, 5, 5), 9), ("d", "n", None, None, (0, 0, 5, 5), 9), (None, "m", "cell", 1, (0, 0, 5, 5), 9)]
    return spark.createDataFrame(rows, BOXES)


def test_regions_that_overlap(spark):
    got = [tuple(r) for r in layout.overlapping(boxes(spark)).orderBy("region_id", "other_id").collect()]
    assert got == [("d", 1, "a", "b", 100), ("d", 1, "b", "c", 100)]
    assert layout.overlapping(boxes(spark).limit(0)).collect() == []


def test_regions_outside_tables(spark):
    got = {r.region_id for r in layout.outside(boxes(spark)).collect()}
    assert got == {"c", "e", "m"}  # one that only touches the table's corner is outside; null types are of no kind
    assert [r.s for r in boxes(spark).select(B.shared_area(F.col("bbox"), F.col("bbox")).alias("s")).where("region_id = 'b'").collect()] == [2500]


def test_rows_of_a_table(spark):
    W = "doc_id string, region_id string, word_idx int, text string, confidence double, bbox struct<x1:int,y1:int,x2:int,y2:int>"
    at = [("Name", 0, 0), ("Age", 100, 0), ("Ann", 0, 50), ("Lee", 10, 50), ("9", 100, 52), (" ", 100, 90), (None, 0, 90)]
    words = [("d", "t", i, w, 0.9, (x, y, x + 8, y + 10)) for i, (w, x, y) in enumerate(at)] + [("d", "t", 0, "Name", 0.9, (0, 0, 8, 10)), ("d", "t", 9, "lost", 0.9, None)]
    regions = spark.createDataFrame([("d", "t", " Table", 1, "x", None)], "doc_id string, region_id string, region_type string, page_number int, raw_text string, ocr_at timestamp")
    got = [tuple(r) for r in layout.table_rows(spark.createDataFrame(words, W), regions).orderBy("i").collect()]
    assert got == [("d", "t", 0, 2, "Name | Age"), ("d", "t", 1, 2, "Ann Lee | 9")]
    books = images.workbooks(spark.createDataFrame(got, "doc_id string, region_id string, i int, n_cells int, text string"), "doc_id", "i", ["i", "text"]).collect()
    z = zipfile.ZipFile(io.BytesIO(books[0].xlsx))
    sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert z.testzip() is None and re.findall(r"<v>(\d+)</v>", sheet) == ["0", "1"] and "Ann Lee | 9" in sheet
    assert b"a&lt;b" in zipfile.ZipFile(io.BytesIO(images.xlsx([["a<b\x00", None, 1.5]]))).read("xl/worksheets/sheet1.xml")


def test_columns_of_an_open_table():
    none, full = np.zeros((10, 400), bool), np.ones((10, 400), bool)
    assert I.column_edges([30, 100], 105, 105, none) == [0, 30, 100]
    assert I.column_edges([5, 100], 150, 150, none) == [5, 100, 150]
    assert I.column_edges([5, 100], 100, 140, full) == [5, 100, 140] and I.column_edges([5, 100], 100, 140, none) == [5, 100]
    assert I.column_edges([5, 100], 100, 260, none) == [5, 100, 260] and I.column_edges([], 40, 40, none) == [0, 40]
    img = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (I.swap_channels(img)[..., 0] == img[..., 2]).all() and I.swap_channels(img[..., 0]).ndim == 2


def test_size_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([("d", 2, 300, 600, 1, bytearray(1), "x")], images.PAGES)
    r = images.page_metadata(pages).first()
    assert (r.page_index, r.width_pt, r.height_pt, r.rotation) == (1, 144.0, 72.0, 0)
    (tmp_path / "a.pdf").write_bytes(images.pdf([np.zeros((300, 600), np.uint8), np.zeros((150, 300, 3), np.uint8)]).replace(b"/Parent 2 0 R /MediaBox [0 0 72", b"/Parent 2 0 R /Rotate 90 /MediaBox [0 0 72"))
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    got = [tuple(r)[1:] for r in images.pdf_metadata(spark, str(tmp_path)).orderBy("page_number").collect()]
    assert got == [(1, 0, 144.0, 72.0, 0), (2, 1, 72.0, 36.0, 90)]


def test_results_are_read_back(spark, tmp_path):
    rows = [("d", 1, 0, -1, "table", (1, 2, 3, 4), "table_001", None, 0), ("d", 1, 1, 0, "cell", None, "cell_001", "table_001", 1)]
    df = spark.createDataFrame(rows, images.RESULTS["layout"])
    images.write_json(df, str(tmp_path / "j"))
    assert sorted(images.read_json(spark, str(tmp_path / "j"), images.RESULTS["layout"]).collect(), key=str) == sorted(df.collect(), key=str)
    assert all(spark.createDataFrame([], x).columns for x in images.RESULTS.values())


def test_a_document_as_one_file(spark):
    page = lambda n, v: ("d", n, 2, 3, 1, bytearray([v] * 6), "x")
    got = pipeline.document_pdfs(spark.createDataFrame([page(2, 9), page(1, 7)], images.PAGES)).collect()
    assert bytes(got[0].pdf) == images.pdf([np.full((2, 3), 7, np.uint8), np.full((2, 3), 9, np.uint8)])


def test_review_goes_back_into_knowledge(spark):
    R = "doc_id string, region_id string, raw_text string, corrected_text string, is_corrected boolean, ocr_at timestamp, entry_id int"
    day = lambda d: datetime(2025, 1, d)
    rows = [("d", "1", "invo1ce", "invoice", True, day(1), 1), ("d", "1", "invo1ce", "invoice", True, day(3), 1), ("d", "2", "invo1ce", "invoice", True, day(2), 1), ("d", "3", "invo1ce", "in voice", True, None, 1), ("d", "4", "x", "y", False, day(1), 1), ("d", "5", "x", None, True, day(1), 1), (None, "6", "x", "y", None, day(1), 1)]
    new = knowledge.reviewed(spark.createDataFrame(rows, R))
    got = {r.ocr_value: r for r in new.collect()}
    assert (got["invoice"].validation_count, got["invoice"].created_at, got["invoice"].last_validated, round(got["invoice"].learned_confidence, 3)) == (2, day(1), day(3), 0.667) and got["in voice"].validation_count == 1
    K = "entry_id string, ocr_value string, validation_count int, created_at timestamp, last_validated timestamp, learned_confidence double"
    old = spark.createDataFrame([(got["invoice"].entry_id, "inv", 5, day(2), day(2), 0.1), ("k", "v", -3, None, None, None), ("k", "v", 2, day(9), None, None), (None, "q", 1, None, None, None)], K)
    out = {r.entry_id: tuple(r)[1:] for r in knowledge.upsert(old, new).collect()}
    assert out[got["invoice"].entry_id][:4] == ("invoice", 7, day(1), day(3)) and out["k"][:2] == ("v", 2) and len(out) == 3
    again = knowledge.upsert(knowledge.upsert(old, new), new.limit(0))
    assert {r.entry_id: tuple(r)[1:] for r in again.collect()} == out
    assert knowledge.reviewed(spark.createDataFrame([], R)).collect() == []


def test_engines_read_words(monkeypatch):
    fake = types.ModuleType("pytesseract")
    fake.Output = types.SimpleNamespace(DICT="dict")
    fake.image_to_data = lambda img, output_type: {"text": ["Hello", " ", "x"], "conf": [91.5, -1, -1], "left": [1, 0, 5], "top": [2, 0, 6], "width": [3, 0, 7], "height": [4, 0, 8]}
    monkeypatch.setitem(sys.modules, "pytesseract", fake)
    assert ocr.tesseract_words(np.zeros((4, 4), np.uint8)) == [ocr.Word("Hello", 0.915, (1, 2, 4, 6)), ocr.Word("x", 0.0, (5, 6, 12, 14))]
    made = []

    class Model:
        def __init__(self, lang, device=None):
            made.append(device)

        def ocr(self, image):
            return [[[[(1.7, 2), (9, 2), (9, 5.2), (1, 5)], ("line", 0.8)], None]] if image.size else [None]

    paddle = types.ModuleType("paddleocr")
    paddle.PaddleOCR = Model
    monkeypatch.setitem(sys.modules, "paddleocr", paddle)
    monkeypatch.setattr(ocr, "_PADDLE", {})
    assert ocr.paddle_words(np.zeros((4, 4, 3), np.uint8)) == [ocr.Word("line", 0.8, (1, 2, 9, 5))]
    assert ocr.paddle_words(np.zeros((0, 4, 3), np.uint8)) == [] and made == ["cpu"]
    with pytest.raises(ValueError):
        ocr.Word("w", 1.5)


def test_micro_batches_have_folders_of_their_own(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, datetime(2025, 1, 1), 5, "a", 1.0)], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(str(src))
    out = feedback.run_once(feedback.latest_per_user(feedback.read_events(spark, str(src))), "update")
    assert [tuple(r)[0] for r in out.collect()] == [5]


def test_bands_cover_every_bit(spark):
    code = "0123456789abcdef" * 4
    df = spark.createDataFrame([(code,)], "hash string").withColumn("w", hashing.words(F.col("hash")))
    for n in (5, 11, 16):
        got = df.select(hashing.bands(F.col("w"), 256, n).alias("b")).first().b
        ends = [round(i * 256 / n) for i in range(n + 1)]
        bits = f"{int(code, 16):0256b}"
        assert got == [int(bits[a:b], 2) for a, b in zip(ends, ends[1:])]
