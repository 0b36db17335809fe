"""Bounding boxes (x, y, width, height) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def x2(b: Column) -> Column:
    return b["x"] + b["width"]


def y2(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    return b["width"].cast("bigint") * b["height"]


def aspect_ratio(b: Column) -> Column:
    return F.when(b["height"] > 0, b["width"].cast("double") / F.nullif(b["height"], F.lit(0)).cast("double")).otherwise(0.0)


def from_corners(c: Column) -> Column:
    return F.struct(c["x1"].alias("x"), c["y1"].alias("y"), (c["x2"] - c["x1"]).alias("width"), (c["y2"] - c["y1"]).alias("height"))


def corners(b: Column) -> Column:
    return F.struct(b["x"].alias("x1"), b["y"].alias("y1"), x2(b).alias("x2"), y2(b).alias("y2"))


def of_polygon(points: Column) -> Column:
    """Corners around an array of (x, y) points, truncated to whole pixels."""
    xs, ys = F.transform(points, lambda p: p["x"].cast("int")), F.transform(points, lambda p: p["y"].cast("int"))
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def padded(b: Column, padding: int, page_w: Column, page_h: Column) -> Column:
    """The crop's corners, clamped to the page."""
    return F.struct(
        F.greatest(F.lit(0), b["x"] - padding).alias("x1"), F.greatest(F.lit(0), b["y"] - padding).alias("y1"),
        F.least(page_w, x2(b) + padding).alias("x2"), F.least(page_h, y2(b) + padding).alias("y2"),
    )


def overlaps(a: Column, b: Column) -> Column:
    return (a["x"] < x2(b)) & (b["x"] < x2(a)) & (a["y"] < y2(b)) & (b["y"] < y2(a))


def shared_area(a: Column, b: Column) -> Column:
    """Pixels in both boxes, 0 for none."""
    w = F.least(x2(a), x2(b)) - F.greatest(a["x"], b["x"])
    h = F.least(y2(a), y2(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)).cast("bigint") * F.greatest(h, F.lit(0))
