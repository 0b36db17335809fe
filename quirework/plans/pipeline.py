"""The five phases over a set of page sources: assess, enhance, detect, extract, read. Each phase is a DataFrame; one
that another needs is computed once, and running an earlier phase again drops what was built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.config import Config
from quirework.functions.image import swap_channels
from quirework.operators import assess, layout, ocr
from quirework.sources import images

PHASES = ("pages", "assessment", "enhanced", "regions", "crops", "words")


class Pipeline:
    def __init__(self, spark: SparkSession, paths: list[str], config: Config | None = None, engine: str | None = None):
        self.spark, self.paths, self.config, self.engine = spark, paths, config or Config(), engine
        self._done: dict[str, DataFrame] = {}

    def _keep(self, phase: str, df: DataFrame) -> DataFrame:
        """Persist the phase; what comes after it is void."""
        for later in PHASES[PHASES.index(phase) :]:
            if (old := self._done.pop(later, None)) is not None:
                old.unpersist()
        self._done[phase] = df.persist()
        return self._done[phase]

    def _need(self, phase: str) -> DataFrame:
        if phase not in self._done:
            make = {"pages": self.pages, "assessment": self.assess, "enhanced": self.enhance, "regions": self.detect_layout, "crops": self.extract, "words": self.ocr}
            make[phase]()
        return self._done[phase]

    def pages(self) -> DataFrame:
        return self._keep("pages", images.pages(self.spark, self.paths, self.config.assessment.render_dpi))

    def assess(self) -> DataFrame:
        return self._keep("assessment", assess.assess(self._need("pages"), self.config.assessment))

    def enhance(self) -> DataFrame:
        return self._keep("enhanced", assess.enhance(self._need("pages"), self._need("assessment"), self.config.enhancement))

    def _source(self) -> DataFrame:
        """Enhanced pages if this pipeline made them, else the originals."""
        return self._done.get("enhanced") or self._need("pages")

    def detect_layout(self) -> DataFrame:
        return self._keep("regions", layout.detect(self._source(), self.config.layout))

    def extract(self) -> DataFrame:
        return self._keep("crops", layout.crops(self._need("regions"), self._source(), self.config.extraction.region_padding))

    def ocr(self) -> DataFrame:
        engine = self.engine or ocr.pick_engine(self.config.ocr.engine, self.config.ocr.fallback_engine)
        return self._keep("words", ocr.read_regions(self._need("crops"), engine))

    def document_flags(self) -> DataFrame:
        return assess.document_flags(self._need("assessment"), "doc_id")

    def summary(self) -> DataFrame:
        return assess.summary(self._need("assessment"))

    def count_by_type(self) -> DataFrame:
        return layout.count_by_type(self._need("regions").where("depth = 0"))

    def region_results(self) -> DataFrame:
        return ocr.region_results(self._need("words").where("error is null"))

    def run_all(self) -> dict[str, DataFrame]:
        self.assess()
        self.enhance()
        self.detect_layout()
        self.extract()
        return {"assessment": self._done["assessment"], "enhanced": self._done["enhanced"], "regions": self._done["regions"], "crops": self._done["crops"], "words": self.ocr()}


def document_pdfs(pages: DataFrame, dpi: int = 300) -> DataFrame:
    """(doc_id, pdf): the pages of each document as one file. Pages are compressed where they are; only the compressed
    pages of a document come together."""
    import zlib

    import numpy as np
    import pandas as pd

    def pack(batches):
        for pdf in batches:
            body = [zlib.compress(np.ascontiguousarray(swap_channels(assess.decode(d, int(h), int(w), int(c)))).tobytes()) for d, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["n_channels"])]
            yield pdf.drop(columns="data").assign(body=body)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(int(r.height), int(r.width), int(r.n_channels), r.body) for r in pdf.sort_values("page_number").itertuples(index=False)]
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "pdf": [images.pdf_of(own, dpi)]})

    cols = pages.select("doc_id", "page_number", "height", "width", "n_channels", "data")
    small = cols.mapInPandas(pack, "doc_id string, page_number int, height int, width int, n_channels int, body binary")
    return small.groupBy("doc_id").applyInPandas(run, "doc_id string, pdf binary")


def manifest(crops: DataFrame) -> DataFrame:
    """Regions with their paths, without pixels, as exported."""
    return crops.select("doc_id", "page_number", "region_id", "parent_region_id", "depth", "ordinal", "type", "bbox", "image_path").withColumn("has_image", F.col("image_path").isNotNull())
