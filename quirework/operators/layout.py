"""Layout: regions of pages, their zones and guards, separators and cells, as relational operators; and the
vectorised detector for page images."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.config import Layout
from quirework.functions import bbox as B
from quirework.functions import image as I
from quirework.operators.assess import WIDTH, decode

REGIONS = "doc_id string, page_number int, ordinal int, parent_ordinal int, type string, bbox struct<x:int,y:int,width:int,height:int>"


def kind(c: str = "region_type") -> Column:
    return F.lower(F.trim(F.col(c)))


def latest_regions(region_ocr: DataFrame) -> DataFrame:
    """Each (doc_id, region_id) once: its latest row."""
    cols = [c for c in region_ocr.columns if c not in ("doc_id", "region_id", "ocr_at")]
    r = region_ocr.groupBy("doc_id", "region_id").agg(F.max(F.struct("ocr_at", *cols)).alias("r"))
    return r.select("doc_id", "region_id", "r.*")


def word_rows(words: DataFrame) -> DataFrame:
    """Each (doc_id, region_id, word_idx) once; of repeated rows the greatest."""
    cols = ("text", "confidence", "bbox")
    w = words.groupBy("doc_id", "region_id", "word_idx").agg(F.max(F.struct(*cols)).alias("w"))
    return w.select("doc_id", "region_id", "word_idx", "w.*")


def region_boxes(words: DataFrame, region_ocr: DataFrame) -> DataFrame:
    """doc_id, region_id, type, page_number, bbox around the region's words; regions without a word box are left out."""
    b = words.where("bbox is not null").groupBy("doc_id", "region_id").agg(*[f("bbox." + k).alias(k) for f, k in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])
    box = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    return latest_regions(region_ocr).select("doc_id", "region_id", kind().alias("type"), "page_number").join(b.select("doc_id", "region_id", box.alias("bbox")), ["doc_id", "region_id"])


def region_ids(regions: DataFrame) -> DataFrame:
    """New ids per document and type, in reading order, three digits at least."""
    w = Window.partitionBy("doc_id", "type").orderBy("page_number", "bbox.y", "bbox.x", "region_id")
    return regions.withColumn("n", F.row_number().over(w)).withColumn("new_id", F.concat_ws("_", "type", F.lpad(F.col("n").cast("string"), F.greatest(F.lit(3), F.length(F.col("n").cast("string"))), F.lit("0"))))


def count_by_type(regions: DataFrame) -> DataFrame:
    return regions.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def zones(regions: DataFrame, page_w: int, page_h: int, cfg: Layout = Layout()) -> DataFrame:
    """Header and footer zones per page: above the topmost table and below the lowest, or the configured shares."""
    t = F.col("type") == "table"
    z = regions.groupBy("doc_id", "page_number").agg(F.min(F.when(t, F.col("bbox.y"))).alias("t0"), F.max(F.when(t, B.y2(F.col("bbox")))).alias("t1"))
    z = z.select("doc_id", "page_number", F.coalesce("t0", F.lit(int(page_h * cfg.header_ratio))).alias("header_bottom"), F.coalesce("t1", F.lit(int(page_h * (1 - cfg.footer_ratio)))).alias("footer_top"))
    return z.withColumns({"has_header": F.col("header_bottom") >= 20, "has_footer": F.col("footer_top") < page_h - 20})


def block_guards(regions: DataFrame, page_w: int, page_h: int, cfg: Layout = Layout()) -> DataFrame:
    """Regions that may be text blocks: neither dust, nor a whole page, nor a streak at the page's edge."""
    x, y, w, h = (F.col(f"bbox.{k}") for k in ("x", "y", "width", "height"))
    big = w.cast("bigint") * h
    keep = (big >= cfg.min_region_area) & (w >= cfg.min_region_dim) & (h >= cfg.min_region_dim) & ~((w > 0.9 * page_w) & (h > 0.9 * page_h)) & (big <= 0.85 * page_w * page_h)
    side = ((x < 20) | (x + w > page_w - 20)) & (w < 60) & (h > 0.2 * page_h)
    edge = ((y < 20) | (y + h > page_h - 20)) & (h < 60) & (w > 0.2 * page_w)
    return regions.where(keep & ~side & ~edge)


def classify(regions: DataFrame, density: Column, page_w: int, page_h: int) -> DataFrame:
    x, y, w, h = (F.col(f"bbox.{k}") for k in ("x", "y", "width", "height"))
    aspect = B.aspect_ratio(F.col("bbox"))
    image = (aspect > 0.4) & (aspect < 2.5) & (density < 0.03)
    title = (y < 0.15 * page_h) & (F.abs(x + w / 2 - page_w / 2) < 0.1 * page_w) & (h > 20)
    return regions.withColumn("block", F.when(image, "image").when(title, "title").otherwise("paragraph"))


def text_lines(documents: DataFrame) -> DataFrame:
    """Rows of the text raster (doc_id, y, line), for relational use."""
    lines = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % WIDTH), F.lit(0))
    return documents.where("text <> ''").select("doc_id", F.posexplode(lines).alias("y", "line"))


def projection(documents: DataFrame) -> DataFrame:
    """(doc_id, y, ink): printed characters per raster row."""
    return text_lines(documents).select("doc_id", "y", F.length(F.regexp_replace("line", r"[\x00-\x20]", "")).alias("ink"))


def merge_nearby(places: DataFrame, keys: list[str], place: str, gap: int) -> DataFrame:
    """keys + (place): one place, the floor of the median, per run of places at most ``gap`` from the one before."""
    w = Window.partitionBy(*keys).orderBy(place)
    run = F.sum(F.when(F.col(place) - F.lag(place).over(w) <= gap, 0).otherwise(1)).over(w)
    return places.withColumn("_run", run).groupBy(*keys, "_run").agg(F.floor(F.percentile(place, 0.5)).cast("int").alias(place)).drop("_run")


def count_lines(profile: DataFrame, keys: list[str], at: str, value: str, above: int) -> DataFrame:
    """keys + (n_lines): runs of values above the bound, without one that the profile begins with."""
    w = Window.partitionBy(*keys).orderBy(at)
    rises = (F.col(value) > above) & (F.lag(value).over(w) <= above)
    return profile.withColumn("_r", F.coalesce(rises, F.lit(False))).groupBy(*keys).agg(F.count_if("_r").alias("n_lines"))


def column_edges(xs: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """keys + (xs): separators with the table's edges put in where they are missing by more than 20 pixels."""
    a = xs.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"), F.max(width).alias("_w"))
    a = a.withColumn("xs", F.when(F.element_at("xs", 1) > 20, F.concat(F.array(F.lit(0)), "xs")).otherwise(F.col("xs")))
    return a.withColumn("xs", F.when(F.col("_w") > F.element_at("xs", -1) + 20, F.concat("xs", F.array("_w"))).otherwise(F.col("xs"))).drop("_w")


def grid(rows: DataFrame, cols: DataFrame, keys: list[str], merged_column: int | None = None) -> DataFrame:
    """Cells of tables: keys + (i, j, x, y, width, height). rows has keys + y, cols keys + x. Cells smaller than 8
    pixels are left out, others lie 2 pixels inside. Of merged_column all rows but the first are one cell, listed
    with the last row."""

    def spans(d: DataFrame, at: str, n: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(at)
        return d.withColumn(f"{at}_to", F.lead(at).over(w)).withColumn(n, F.row_number().over(w) - 1).where(f"{at}_to is not null")

    c = spans(rows, "y", "i").join(spans(cols, "x", "j"), keys)
    if merged_column is not None:
        m = (F.col("j") == merged_column) & (F.col("i") >= 1)
        one = c.where(m).groupBy(*keys, "j", "x", "x_to").agg(F.min("y").alias("y"), F.max("y_to").alias("y_to"), F.max("i").alias("i"))
        c = c.where(~m).unionByName(one.select(*c.columns))
    c = c.where((F.col("x_to") - F.col("x") >= 8) & (F.col("y_to") - F.col("y") >= 8))
    at_least = lambda e: F.greatest(F.lit(1), e)
    return c.select(*keys, "i", "j", (F.col("x") + 2).alias("x"), (F.col("y") + 2).alias("y"), at_least(F.col("x_to") - F.col("x") - 4).alias("width"), at_least(F.col("y_to") - F.col("y") - 4).alias("height"))


def table_separators(words: DataFrame, region_ocr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (y) and columns (x) of table regions, from where their words begin, relative to the table's box."""
    boxes = region_boxes(words, region_ocr).where("type = 'table'").select("doc_id", "region_id", "bbox")
    w = words.where("bbox is not null").select("doc_id", "region_id", F.col("bbox").alias("b")).join(boxes, ["doc_id", "region_id"])
    keys = ["doc_id", "region_id"]
    ys = merge_nearby(w.select(*keys, (F.col("b.y1") - F.col("bbox.y")).alias("y")).distinct(), keys, "y", 20)
    xs = merge_nearby(w.select(*keys, (F.col("b.x1") - F.col("bbox.x")).alias("x")).distinct(), keys, "x", 20)
    return ys, xs


def detect(pages: DataFrame, cfg: Layout = Layout()) -> DataFrame:
    """Regions of page images (REGIONS plus region_id, parent_region_id, depth). Pages stream through; a page whose
    bytes do not fit its shape gives no regions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    img = decode(r.data, r.height, r.width, r.n_channels)
                except (TypeError, ValueError):
                    continue
                for i, (t, box, parent) in enumerate(I.detect_page(img, cfg)):
                    rows.append((r.doc_id, r.page_number, i, parent, t, dict(zip(("x", "y", "width", "height"), map(int, box)))))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "ordinal", "parent_ordinal", "type", "bbox"])

    d = pages.select("doc_id", "page_number", "height", "width", "n_channels", "data").mapInPandas(run, REGIONS)
    w = Window.partitionBy("doc_id", "type").orderBy("page_number", "ordinal")
    d = d.withColumn("region_id", F.format_string("%s_%03d", "type", F.row_number().over(w)))
    parent = d.select("doc_id", "page_number", F.col("ordinal").alias("parent_ordinal"), F.col("region_id").alias("parent_region_id"))
    return d.join(parent, ["doc_id", "page_number", "parent_ordinal"], "left").withColumn("depth", F.when(F.col("parent_region_id").isNull(), 0).otherwise(1))


def crops(regions: DataFrame, pages: DataFrame, padding: int = 4) -> DataFrame:
    """Regions with their crop (data, height, width, n_channels) and image_path. A region whose page is missing or
    whose crop is empty has none, and neither have its children."""
    # a page meets its boxes, so its pixels move once whatever the number of regions
    boxes = regions.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("region_id", "parent_region_id", "bbox")).alias("_boxes"))
    j = pages.select("doc_id", "page_number", "height", "width", "n_channels", "data").join(boxes, ["doc_id", "page_number"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    img = decode(r.data, int(r.height), int(r.width), int(r.n_channels))
                except (TypeError, ValueError):
                    continue
                got = {x["region_id"]: (x["parent_region_id"], I.crop(img, x["bbox"]["x"], x["bbox"]["y"], x["bbox"]["width"], x["bbox"]["height"], padding)) for x in r[-1]}
                for name, (parent, c) in got.items():
                    if c.size and (parent is None or (parent in got and got[parent][1].size)):
                        out.append((r.doc_id, name, c.tobytes(), c.shape[0], c.shape[1], int(r.n_channels)))
            yield pd.DataFrame(out, columns=["doc_id", "region_id", "data", "height", "width", "n_channels"], dtype=object)

    c = j.select("doc_id", "height", "width", "n_channels", "data", "_boxes").mapInPandas(run, "doc_id string, region_id string, data binary, height int, width int, n_channels int")
    own = regions.join(c, ["doc_id", "region_id"], "left")
    return own.withColumn("image_path", F.when(F.col("data").isNotNull(), F.concat(F.lit("layouts/"), "doc_id", F.lit("/"), "region_id", F.lit(".png"))))


def overlapping(boxes: DataFrame) -> DataFrame:
    """(doc_id, page_number, region_id, other_id, area): regions of one page, region_id < other_id, that share pixels, and
    how many. A page's regions are few, so the join on the page is what bounds the pairs; null pages meet nothing."""
    a = boxes.select("doc_id", "page_number", "region_id", "bbox")
    b = a.select("doc_id", "page_number", F.col("region_id").alias("other_id"), F.col("bbox").alias("other"))
    j = a.join(b, ["doc_id", "page_number"]).where((F.col("region_id") < F.col("other_id")) & B.overlaps(F.col("bbox"), F.col("other")))
    return j.select("doc_id", "page_number", "region_id", "other_id", B.shared_area(F.col("bbox"), F.col("other")).alias("area"))


def outside(boxes: DataFrame, kinds: tuple[str, ...] = ("table", "header", "footer")) -> DataFrame:
    """Regions of other types that touch no region of these types on their page (spatial anti-join)."""
    blockers = boxes.where(F.col("type").isin(*kinds)).select(F.col("doc_id").alias("_d"), F.col("page_number").alias("_p"), F.col("bbox").alias("_b"))
    rest = boxes.where(~F.col("type").isin(*kinds))
    on = (rest["doc_id"] == blockers["_d"]) & (rest["page_number"] == blockers["_p"]) & B.overlaps(rest["bbox"], blockers["_b"])
    return rest.join(blockers, on, "left_anti")


def table_rows(words: DataFrame, region_ocr: DataFrame) -> DataFrame:
    """Rebuilt tables: (doc_id, region_id, i, n_cells, text), the cells of row i joined by `` | ``, each with its words in
    order. A word belongs to the row and column whose separator is the nearest to where it begins, the first of two."""
    ys, xs = table_separators(words, region_ocr)
    keys = ["doc_id", "region_id"]
    boxes = region_boxes(words, region_ocr).where("type = 'table'").select(*keys, F.col("bbox.x").alias("_x"), F.col("bbox.y").alias("_y"))
    w = word_rows(words).where("bbox is not null and trim(text) <> ''").join(boxes, keys)
    w = w.select(*keys, "word_idx", F.trim("text").alias("text"), (F.col("bbox.x1") - F.col("_x")).alias("x"), (F.col("bbox.y1") - F.col("_y")).alias("y"))
    for seps, at, n in ((ys, "y", "i"), (xs, "x", "j")):
        s = seps.groupBy(*keys).agg(F.array_sort(F.collect_list(at)).alias("_s"))
        w = w.join(s, keys).withColumn(n, F.array_min(F.transform("_s", lambda e, k: F.struct(F.abs(e - F.col(at)).alias("d"), k.alias("k"))))["k"]).drop("_s")
    cell = w.groupBy(*keys, "i", "j").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda e: e["text"]), " ").alias("t"))
    row = F.array_sort(F.collect_list(F.struct("j", "t")))
    return cell.groupBy(*keys, "i").agg(F.count(F.lit(1)).cast("int").alias("n_cells"), F.array_join(F.transform(row, lambda e: e["t"]), " | ").alias("text"))
