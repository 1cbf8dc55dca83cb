"""Blobs: contours found in a frame, and what is measured of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, fitting, polygons


def index(blobs: DataFrame, mode: str = "pca") -> DataFrame:
    """frame, blob_index, x, y (the contour's centroid), area, cx, cy, w, h, angle (its fitted box) and x0, y0, x1, y1 (its bounds). blobs: frame, blob_index, contour (array of x, y)."""
    c = F.col("contour")
    measured = blobs.select("frame", "blob_index", polygons.centroid(c).alias("_c"), F.abs(boxes.signed_area(c)).alias("area"), *[f(F.transform(c, lambda p: p[k])).alias(f"{k}{i}") for i, f in enumerate((F.array_min, F.array_max)) for k in "xy"])
    box = fitting.fitted(blobs, "contour", mode)
    return measured.join(box, ["frame", "blob_index"]).select("frame", "blob_index", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), "area", "cx", "cy", "w", "h", "angle", "x0", "y0", "x1", "y1")
