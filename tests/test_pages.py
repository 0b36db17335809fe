"""The page pipeline from images to words."""

import numpy as np
import pytest

from quirework.config import Assessment, Enhancement
from quirework.operators import assess, layout, ocr
from quirework.sources.images import PAGES
from tests.test_image import ruled, square


@pytest.fixture(scope="module")
def pages(spark):
    flat = np.full((200, 300), 180, np.uint8)
    rows = [("flat", 1, 200, 300, 1, flat.tobytes(), "f"), ("square", 1, 100, 100, 1, square().tobytes(), "s"), ("ruled", 1, 600, 800, 1, ruled().tobytes(), "r"), ("bad", 1, 9, 9, 1, b"x", "b")]
    return spark.createDataFrame([(*r[:5], bytearray(r[5]), r[6]) for r in rows], PAGES)


def test_assessment(pages):
    a = {r.doc_id: r for r in assess.assess(pages).collect()}
    assert a["flat"].is_blurry and a["flat"].is_low_contrast and a["flat"].quality == "acceptable" and not a["flat"].needs_deskew
    assert a["square"].blur_score == 1092.42 and not a["square"].is_blurry
    assert (a["ruled"].width_px, a["ruled"].height_px) == (800, 600)
    assert a["bad"].blur_score is None and not a["bad"].enhancement_needed
    strict = {r.doc_id: r.is_blurry for r in assess.assess(pages, Assessment(blur_threshold=5000)).collect()}
    assert strict["square"]


def test_document_flags_and_plan(spark):
    cols = "doc_id string, is_blurry boolean, is_noisy boolean, is_low_contrast boolean, needs_deskew boolean, enhancement_needed boolean, skew_angle double"
    p = spark.createDataFrame([("bad", True, True, True, True, True, 3.5), ("bad", False, False, False, False, False, 0.0), ("good", False, False, False, False, False, 0.5), ("none", None, None, None, None, None, None)], cols)
    f = {r.doc_id: r for r in assess.document_flags(p, "doc_id").collect()}
    assert f["bad"].recommended == ["deskew", "sharpen", "denoise", "contrast_enhancement"] and f["bad"].page_count == 2
    assert f["good"].recommended == [] and f["none"].any_is_blurry is False
    ops = {(r.doc_id, r.is_blurry): r.ops for r in assess.enhancement_plan(p).collect()}
    assert ops["bad", True] == ["deskew", "denoise", "contrast", "sharpen"] and ops["good", False] == []
    off = assess.enhancement_plan(p, Enhancement(auto_deskew=False, auto_denoise=False, auto_sharpen=False)).where("is_blurry").first().ops
    assert off == ["contrast"]


def test_enhance(pages):
    good = pages.where("doc_id <> 'bad'")
    out = {r.doc_id: r for r in assess.enhance(good, assess.assess(good)).collect()}
    src = {r.doc_id: r for r in good.collect()}
    assert set(out) == set(src) and all(len(out[k].data) == len(src[k].data) for k in out)


def test_detect_and_crop(spark, pages):
    r = layout.detect(pages).persist()
    t = {x.type: x["count"] for x in r.where("doc_id = 'ruled'").groupBy("type").count().collect()}
    assert t["table"] == 1 and t["cell"] == 9
    assert r.select("doc_id", "region_id").distinct().count() == r.count()
    assert {x.parent_region_id for x in r.where("type = 'cell'").collect()} == {"table_001"}
    c = layout.crops(r, pages.where("doc_id = 'ruled'"))
    got = {(x.doc_id, x.region_id): x.image_path for x in c.collect()}
    assert got["ruled", "cell_001"] == "layouts/ruled/cell_001.png"
    missing = layout.crops(r, pages.limit(0)).collect()
    assert len(missing) == r.count() and all(x.image_path is None for x in missing)


def test_engines(spark, pages, monkeypatch):
    class Reader:
        name = "fixed"

        def is_available(self):
            return True

        def run(self, image):
            if image.shape[0] > 100:
                raise OSError("too tall")
            return [ocr.Word("Hello", 0.8, (0, 0, 3, 3)), ocr.Word("World", 0.6)]

    with pytest.raises(RuntimeError):
        ocr.pick_engine("paddleocr", "none")
    monkeypatch.setitem(ocr.ENGINES, "fixed", Reader)
    assert ocr.pick_engine("paddleocr", "fixed") == "fixed"
    r = layout.detect(pages.where("doc_id = 'ruled'"))
    w = ocr.read_regions(layout.crops(r, pages), "fixed").collect()
    assert {x.error for x in w if x.region_id == "table_001"} == {"OSError: too tall"}
    assert [(x.word_idx, x.text) for x in sorted((x for x in w if x.region_id == "cell_001"), key=lambda x: x.word_idx)] == [(0, "Hello"), (1, "World")]
    with pytest.raises(ValueError):
        ocr.Word("x", 1.5)


def test_region_results_of_dirty_words(spark):
    cols = "doc_id string, region_id string, word_idx int, text string, confidence double, bbox struct<x1:int,y1:int,x2:int,y2:int>, extra string"
    rows = [("d", "r", 1, " World ", 0.6, None, "a"), ("d", "r", 0, "Hello", 0.8, None, "b"), ("d", "r", 0, "Hello", 0.8, None, "c"), ("d", "r", 2, None, 0.1, None, "d"), ("d", "r", 3, "  ", 0.1, None, "e"), ("d", "s", 0, "x", 1.5, None, "f"), ("d", "t", 0, "y", float("nan"), None, "g")]
    got = {r.region_id: (r.n_words, r.text, r.confidence_e4) for r in ocr.region_results(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"r": (2, "Hello World", 7000), "s": (1, "x", 0), "t": (1, "y", 0)}
    assert ocr.region_results(spark.createDataFrame([], cols)).collect() == []


def test_final_text_and_doubts(spark):
    cols = "doc_id string, region_id string, region_type string, page_number int, raw_text string, region_confidence double, corrected_text string, is_corrected boolean, ocr_at timestamp"
    rows = [("d", "a", " Cell", 1, "invo1ce", 0.5, "invoice", True, None), ("d", "b", "cell", 1, "raw", 0.95, "no", False, None), ("d", "c", None, None, "raw", None, None, True, None)]
    df = spark.createDataFrame(rows + rows[:1], cols)
    assert {r.region_id: r.final_text for r in ocr.final_text(df).collect()} == {"a": "invoice", "b": "raw", "c": None}
    assert {r.region_id for r in ocr.doubtful(df).collect()} == {"a", "c"}
