"""Page quality: scores, flags, rating, document summary and the plan of enhancements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.config import Assessment, Enhancement
from quirework.functions import image as I

WIDTH = 80
MOMENTS = "height int, width int, n bigint, lap_sum bigint, lap_sq bigint, sum bigint, sq bigint, noise_sum bigint, otsu int, dark bigint"


def text_raster(text: str, width: int = WIDTH) -> np.ndarray:
    """A text as a gray page: code points, at most 255, folded at ``width``, the last row filled with blanks."""
    v = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 255).astype(np.uint8)
    h = -(-v.size // width)
    return np.concatenate([v, np.full(h * width - v.size, 32, np.uint8)]).reshape(h, width)


def measure(gray: np.ndarray) -> tuple:
    n, s1, s2 = I.moments(gray)
    _, l1, l2 = I.moments(I.laplacian(gray))
    return gray.shape[0], gray.shape[1], n, l1, l2, s1, s2, I.noise_sum(gray), I.otsu(gray), int((gray <= 180).sum())


def text_moments(documents: DataFrame) -> DataFrame:
    """Exact integer moments of each text's raster, one narrow pass. Null and empty texts give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *measure(text_raster(t))) for d, t in zip(pdf["doc_id"], pdf["text"]) if t]
            yield pd.DataFrame(rows, columns=["doc_id", "height", "width", "n", "lap_sum", "lap_sq", "sum", "sq", "noise_sum", "otsu", "dark"])

    return documents.select("doc_id", "text").where("text <> ''").mapInPandas(run, f"doc_id bigint, {MOMENTS}")


def text_histogram(documents: DataFrame) -> DataFrame:
    """(doc_id, v, n): counts of each intensity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                v, n = np.unique(text_raster(t), return_counts=True)
                yield pd.DataFrame({"doc_id": d, "v": v.astype(np.int32), "n": n.astype(np.int64)})

    return documents.select("doc_id", "text").where("text <> ''").mapInPandas(run, "doc_id bigint, v int, n bigint")


def variance(n: str, s1: str, s2: str) -> Column:
    return (F.col(n) * F.col(s2) - F.col(s1) * F.col(s1)).cast("double") / (F.col(n) * F.col(n)).cast("double")


def scores(m: DataFrame) -> DataFrame:
    """blur, contrast and noise scores from the moments; skew 0.0 where none was measured."""
    skew = F.col("skew_angle") if "skew_angle" in m.columns else F.lit(0.0)
    return m.withColumns({
        "blur_score": variance("n", "lap_sum", "lap_sq"), "contrast_score": F.sqrt(variance("n", "sum", "sq")),
        "noise_score": F.col("noise_sum").cast("double") / (F.col("n") * 255).cast("double"), "skew_angle": skew,
    })


def flags(s: DataFrame, cfg: Assessment = Assessment()) -> DataFrame:
    """Flags on the unrounded scores and the rating: no issue good, one or two acceptable, more poor."""
    names = {
        "is_blurry": F.col("blur_score") < cfg.blur_threshold, "is_noisy": F.col("noise_score") > cfg.noise_threshold,
        "is_low_contrast": F.col("contrast_score") < cfg.contrast_threshold, "needs_deskew": F.abs("skew_angle") > cfg.skew_threshold,
    }
    issues = sum((c.cast("int") for c in names.values()), F.lit(0))
    return s.withColumns(names | {"enhancement_needed": issues > 0, "quality": F.when(issues == 0, "good").when(issues <= 2, "acceptable").otherwise("poor")})


def enhancement_plan(f: DataFrame, cfg: Enhancement = Enhancement()) -> DataFrame:
    """Operations a page needs, in order; contrast is gated by its flag only."""
    ops = F.array(
        F.when(F.lit(cfg.auto_deskew) & F.col("needs_deskew") & (F.abs("skew_angle") > 0.1), "deskew"), F.when(F.lit(cfg.auto_denoise) & F.col("is_noisy"), "denoise"),
        F.when(F.col("is_low_contrast"), "contrast"), F.when(F.lit(cfg.auto_sharpen) & F.col("is_blurry"), "sharpen"),
    )
    return f.withColumn("ops", F.filter(ops, lambda x: x.isNotNull()))


def recommendations(blurry: Column, noisy: Column, low: Column, skewed: Column) -> Column:
    return F.filter(F.array(F.when(skewed, "deskew"), F.when(blurry, "sharpen"), F.when(noisy, "denoise"), F.when(low, "contrast_enhancement")), lambda x: x.isNotNull())


def document_flags(pages: DataFrame, key: str) -> DataFrame:
    """One row per document: page_count, any_* flags and the recommended enhancements."""
    any_ = {f"any_{c}": F.coalesce(F.bool_or(c), F.lit(False)) for c in ("is_blurry", "is_noisy", "is_low_contrast", "needs_deskew", "enhancement_needed")}
    d = pages.groupBy(key).agg(F.count(F.lit(1)).alias("page_count"), *[v.alias(k) for k, v in any_.items()])
    return d.withColumn("recommended", recommendations(F.col("any_is_blurry"), F.col("any_is_noisy"), F.col("any_is_low_contrast"), F.col("any_needs_deskew")))


def summary(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(c).alias(c) for c in ("is_blurry", "is_noisy", "is_low_contrast", "needs_deskew")])


def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else a


def assess(pages: DataFrame, cfg: Assessment = Assessment()) -> DataFrame:
    """page_assessment of page images (doc_id, page_number, height, width, n_channels, data). Rows stream through; a
    page whose bytes do not fit its shape has null scores, is not flagged and keeps its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    gray = I.to_gray(decode(r.data, r.height, r.width, r.n_channels))
                    rows.append((r.doc_id, r.page_number, *measure(gray), I.skew_angle(gray)))
                except (TypeError, ValueError):
                    rows.append((r.doc_id, r.page_number, r.height, r.width, *[None] * 9))
            out = pd.DataFrame(rows, columns=["doc_id", "page_number", "height", "width", "n", "lap_sum", "lap_sq", "sum", "sq", "noise_sum", "otsu", "dark", "skew_angle"], dtype=object)
            yield out

    cols = pages.select("doc_id", "page_number", "height", "width", "n_channels", "data")
    m = cols.mapInPandas(run, f"doc_id string, page_number int, {MOMENTS}, skew_angle double")
    f = flags(scores(m), cfg)
    calm = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_blurry", "is_noisy", "is_low_contrast", "needs_deskew", "enhancement_needed")}
    return f.withColumns(calm).select(
        "doc_id", "page_number", F.lit(cfg.render_dpi).cast("double").alias("dpi"), F.lit(cfg.render_dpi >= cfg.min_dpi).alias("dpi_ok"),
        F.round("blur_score", 2).alias("blur_score"), "is_blurry", F.round("noise_score", 4).alias("noise_score"), "is_noisy",
        F.round("contrast_score", 2).alias("contrast_score"), "is_low_contrast", F.round("skew_angle", 2).alias("skew_angle"), "needs_deskew",
        "quality", "enhancement_needed", F.col("width").alias("width_px"), F.col("height").alias("height_px"),
    )


def enhance(pages: DataFrame, assessment: DataFrame, cfg: Enhancement = Enhancement()) -> DataFrame:
    """Pages after the operations they need; pages that need none skip Python. Pages without an assessment get
    denoise, contrast and sharpen."""
    plan = enhancement_plan(assessment, cfg).select("doc_id", "page_number", "ops", F.col("skew_angle").alias("_skew"))
    j = pages.join(plan, ["doc_id", "page_number"], "left")
    j = j.withColumn("ops", F.coalesce("ops", F.array(F.lit("denoise"), F.lit("contrast"), F.lit("sharpen"))))
    names = pages.columns

    todo = j.where("size(ops) > 0").withColumnRenamed("_skew", "skew")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        do = {"denoise": I.denoise, "contrast": lambda x: I.clahe(x, cfg.clahe_clip_limit, cfg.clahe_tiles), "sharpen": I.sharpen}
        for pdf in batches:
            data = []
            for r in pdf.to_dict("records"):
                img = decode(r["data"], r["height"], r["width"], r["n_channels"])
                for op in r["ops"]:
                    img = I.deskew(img, r["skew"] or 0.0) if op == "deskew" else do[op](img)
                data.append(np.ascontiguousarray(img).tobytes())
            pdf["data"] = data
            yield pdf[names]

    return j.where("size(ops) = 0").select(*names).unionByName(todo.mapInPandas(run, pages.schema))


def page_hashes(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, phash, dhash, ahash) of 64 bits each; pages whose bytes do not fit their shape have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    own = I.all_hashes(I.to_gray(decode(r.data, r.height, r.width, r.n_channels)))
                except (TypeError, ValueError):
                    own = None, None, None
                rows.append((r.doc_id, r.page_number, *own))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "phash", "dhash", "ahash"], dtype=object)

    return pages.select("doc_id", "page_number", "height", "width", "n_channels", "data").mapInPandas(run, "doc_id string, page_number int, phash string, dhash string, ahash string")


def morphology(documents: DataFrame, above: int = 32) -> DataFrame:
    """(doc_id, dark, dilated, opened): printed pixels of each text's raster, after growing them by a 3 x 3 square, and
    those that lie in horizontal strokes of at least 3."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                m = text_raster(text) > above
                rows.append((d, int(m.sum()), int(I.dilate(m, 3, 3).sum()), int(I.opening(m, 3, 1).sum())))
            yield pd.DataFrame(rows, columns=["doc_id", "dark", "dilated", "opened"])

    return documents.select("doc_id", "text").where("text <> ''").mapInPandas(run, "doc_id bigint, dark bigint, dilated bigint, opened bigint")
