"""OCR results: the engine plug-in, words to regions to documents, confidence, doubts and corrections."""

from __future__ import annotations

import importlib.util
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.image import swap_channels
from quirework.operators.assess import decode
from quirework.operators.layout import kind, latest_regions, word_rows

WORDS = "doc_id string, region_id string, word_idx int, text string, confidence double, bbox struct<x1:int,y1:int,x2:int,y2:int>, error string"


@dataclass(frozen=True)
class Word:
    text: str
    confidence: float
    bbox: tuple[int, int, int, int] | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.confidence <= 1:
            raise ValueError(f"confidence {self.confidence} is outside 0..1")


class Engine(Protocol):
    """What an OCR engine has to offer. One object is made per Python worker."""

    name: str

    def is_available(self) -> bool: ...

    def run(self, image: np.ndarray) -> list[Word]: ...


class ModuleEngine:
    """Adapter of an engine whose Python module may be missing; ``reader`` turns an image into words."""

    def __init__(self, name: str, module: str, reader: Callable[[np.ndarray], list[Word]] | None = None, binary: str | None = None):
        self.name, self.module, self.reader, self.binary = name, module, reader, binary

    def is_available(self) -> bool:
        return self.reader is not None and importlib.util.find_spec(self.module) is not None and (self.binary is None or shutil.which(self.binary) is not None)

    def run(self, image: np.ndarray) -> list[Word]:
        if self.reader is None:
            raise RuntimeError(f"{self.name} has no reader")
        return self.reader(image)


def tesseract_words(image: np.ndarray) -> list[Word]:
    """Words of one crop by Tesseract's table of words; blank ones are left out, a confidence of -1 is 0."""
    import pytesseract

    rows = pytesseract.image_to_data(swap_channels(image), output_type=pytesseract.Output.DICT)
    out = []
    for text, conf, x, y, w, h in zip(*(rows[k] for k in ("text", "conf", "left", "top", "width", "height"))):
        if word := str(text).strip():
            out.append(Word(word, min(1.0, max(0.0, float(conf) / 100)), (int(x), int(y), int(x) + int(w), int(y) + int(h))))
    return out


_PADDLE: dict[str, object] = {}


def paddle_words(image: np.ndarray) -> list[Word]:
    """Lines of one crop by PaddleOCR, the model loaded once per worker; a polygon becomes the box around it."""
    if "model" not in _PADDLE:
        import inspect

        from paddleocr import PaddleOCR

        known = inspect.signature(PaddleOCR.__init__).parameters
        _PADDLE["model"] = PaddleOCR(lang="en", **({"use_gpu": False} if "use_gpu" in known else {"device": "cpu"} if "device" in known else {}))
    pages = _PADDLE["model"].ocr(image) or []
    out = []
    for points, (text, conf) in (line for line in (pages[0] if pages else None) or [] if line is not None):
        xs, ys = [int(p[0]) for p in points], [int(p[1]) for p in points]
        out.append(Word(str(text), min(1.0, max(0.0, float(conf))), (min(xs), min(ys), max(xs), max(ys))))
    return out


ENGINES: dict[str, Callable[[], Engine]] = {
    "paddleocr": lambda: ModuleEngine("paddleocr", "paddleocr", paddle_words),
    "tesseract": lambda: ModuleEngine("tesseract", "pytesseract", tesseract_words, "tesseract"),
}


def pick_engine(primary: str, fallback: str | None = None) -> str:
    """Name of the first engine that is available; none is an error."""
    for name in (primary, fallback):
        if name in ENGINES and ENGINES[name]().is_available():
            return name
    raise RuntimeError(f"no OCR engine: neither {primary} nor {fallback} is available")


#: Per worker: the engines its tasks share.
_HELD: dict[str, tuple[bytes, Engine]] = {}


def held(name: str, make: Callable[[], Engine]) -> Engine:
    """The worker's engine of that name; one registered anew under the name replaces it."""
    from pyspark import cloudpickle

    mark = cloudpickle.dumps(make)
    if name not in _HELD or _HELD[name][0] != mark:
        _HELD[name] = mark, make()
    return _HELD[name][1]


def read_regions(crops: DataFrame, engine: str) -> DataFrame:
    """Words of region crops. A region without crop gives no rows, an engine's failure a row with its error."""
    make = ENGINES[engine]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = held(engine, make)
        for pdf in batches:
            rows: list[tuple] = []
            for r in pdf.itertuples(index=False):
                try:
                    for i, w in enumerate(reader.run(decode(r.data, int(r.height), int(r.width), int(r.n_channels)))):
                        box = None if w.bbox is None else dict(zip(("x1", "y1", "x2", "y2"), w.bbox))
                        rows.append((r.doc_id, r.region_id, i, w.text, w.confidence, box, None))
                except Exception as e:  # noqa: BLE001 - an engine may raise anything; the row tells
                    rows.append((r.doc_id, r.region_id, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "region_id", "word_idx", "text", "confidence", "bbox", "error"], dtype=object)

    return crops.where("data is not null").select("doc_id", "region_id", "data", "height", "width", "n_channels").mapInPandas(run, WORDS)


def percent_confidence(c: Column) -> Column:
    """Confidence of 0..100, -1 for none, as 0..1."""
    return F.when(c == -1, 0.0).otherwise(F.greatest(F.lit(0.0), c / 100))


def clean_words(words: DataFrame) -> DataFrame:
    """Each word once, stripped, blank ones left out; confidences outside 0..1, missing ones included, are null."""
    c = F.col("confidence")
    w = word_rows(words).withColumn("text", F.trim("text")).where("text <> ''")
    return w.withColumn("confidence", F.when((c >= 0) & (c <= 1), c))


def e4(c: Column) -> Column:
    """Confidence in ten-thousandths, whole, so that sums are exact in any order."""
    return F.round(c * 10000).cast("bigint")


def mean_e4(total: Column, n: Column) -> Column:
    """Mean of whole ten-thousandths rounded half up, 0 for none."""
    return F.when(n > 0, F.floor((total * 2 + n) / F.nullif(n * 2, F.lit(0)))).otherwise(0).cast("bigint")


def region_results(words: DataFrame) -> DataFrame:
    """doc_id, region_id, n_words, text (words joined by a blank, in order), confidence_e4 (mean of the usable ones)."""
    r = clean_words(words).groupBy("doc_id", "region_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.array_sort(F.collect_list(F.struct("word_idx", "text"))).alias("w"),
        F.coalesce(F.sum(e4(F.col("confidence"))), F.lit(0)).alias("s"), F.count("confidence").alias("n"),
    )
    return r.select("doc_id", "region_id", "n_words", F.array_join("w.text", " ").alias("text"), mean_e4(F.col("s"), F.col("n")).alias("confidence_e4"))


def document_results(words: DataFrame, region_ocr: DataFrame, doubt_threshold: float = 0.80) -> DataFrame:
    """One row per document: page_count (greatest page number), n_regions, total_words, mean_confidence_e4 over regions
    with words, doubtful_region_count."""
    j = latest_regions(region_ocr).select("doc_id", "region_id", "page_number").join(region_results(words), ["doc_id", "region_id"], "left")
    has = F.col("n_words") > 0
    d = j.groupBy("doc_id").agg(
        F.coalesce(F.max("page_number"), F.lit(0)).alias("page_count"), F.count(F.lit(1)).alias("n_regions"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("total_words"),
        F.coalesce(F.sum(F.when(has, F.col("confidence_e4"))), F.lit(0)).alias("s"), F.count_if(has).alias("n"),
        F.count_if(F.coalesce("confidence_e4", F.lit(0)) < int(round(doubt_threshold * 10000))).alias("doubtful_region_count"),
    )
    return d.select("doc_id", "page_count", "n_regions", "total_words", mean_e4(F.col("s"), F.col("n")).alias("mean_confidence_e4"), "doubtful_region_count")


def doubtful(region_ocr: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Regions below the threshold; a missing confidence counts as 0."""
    c = F.coalesce(F.nanvl("region_confidence", F.lit(0.0)), F.lit(0.0))
    return latest_regions(region_ocr).where(c < threshold).select("doc_id", "region_id", kind().alias("region_type"), "page_number")


def final_text(region_ocr: DataFrame) -> DataFrame:
    """The corrected text of corrected regions, even if it is null, else the raw text."""
    return latest_regions(region_ocr).select("doc_id", "region_id", F.when(F.col("is_corrected"), F.col("corrected_text")).otherwise(F.col("raw_text")).alias("final_text"))


def confidence_levels(words: DataFrame, region_ocr: DataFrame) -> DataFrame:
    """Word counts and mean confidence by document and type, by type, and over all, in one pass over grouping sets."""
    types = latest_regions(region_ocr).select("doc_id", "region_id", kind().alias("region_type"))
    w = clean_words(words).where("confidence is not null").join(types, ["doc_id", "region_id"]).select("doc_id", "region_type", e4(F.col("confidence")).alias("c"))
    g = w.groupingSets([["doc_id", "region_type"], ["region_type"], []], "doc_id", "region_type").agg(F.count(F.lit(1)).alias("n_words"), F.sum("c").alias("s"), F.grouping_id("doc_id", "region_type").alias("level"))
    return g.select("level", "doc_id", "region_type", "n_words", mean_e4(F.col("s"), F.col("n_words")).alias("confidence_e4"))


def review_units(words: DataFrame, region_ocr: DataFrame, threshold: float = 0.80) -> DataFrame:
    """What a person should review: doubtful words; of doubtful regions without words the cell, never page or table."""
    t = latest_regions(region_ocr).select("doc_id", "region_id", kind().alias("region_type"), "region_confidence")
    w = clean_words(words)
    by_word = w.where(F.coalesce("confidence", F.lit(0.0)) < threshold).select("doc_id", "region_id", F.lit("word").alias("unit"), "word_idx")
    rest = t.join(w.select("doc_id", "region_id").distinct(), ["doc_id", "region_id"], "left_anti")
    by_cell = rest.where((F.col("region_type") == "cell") & (F.coalesce(F.nanvl("region_confidence", F.lit(0.0)), F.lit(0.0)) < threshold)).select("doc_id", "region_id", F.lit("cell").alias("unit"), F.lit(None).cast("int").alias("word_idx"))
    return by_word.unionByName(by_cell)


def confidence_by_unit(region_ocr: DataFrame) -> DataFrame:
    """(region_type, unit, n, confidence_e4): mean confidence of characters, words and regions as each region states it,
    in whole ten-thousandths; values outside 0..1 do not count."""
    units = ("char", "word", "region")
    extra = F.struct("region_type", "page_number", "raw_text", *[f"{u}_confidence" for u in units])
    key = F.struct(F.col("ocr_at").isNotNull(), "ocr_at", F.col("region_type").isNotNull(), "region_type", F.col("page_number").isNotNull(), "page_number", F.col("raw_text").isNotNull(), "raw_text")
    r = region_ocr.groupBy("doc_id", "region_id").agg(F.max_by(extra, key).alias("r"))
    each = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(f"r.{u}_confidence").alias("c")) for u in units])
    e = r.select(kind("r.region_type").alias("region_type"), F.explode(each).alias("e")).select("region_type", "e.unit", "e.c").where("c >= 0 and c <= 1")
    total, n = F.sum(e4(F.col("c"))), F.count(F.lit(1))
    return e.groupBy("region_type", "unit").agg(n.alias("n"), F.floor((2 * total + n) / (2 * n)).cast("bigint").alias("confidence_e4"))
