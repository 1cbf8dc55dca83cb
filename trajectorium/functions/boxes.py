"""Oriented and axis-aligned boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corners(cx: Column, cy: Column, w: Column, h: Column, heading: Column) -> Column:
    """Four corners, array of (x, y); the long side w lies along the heading."""
    ux, uy = F.sin(F.radians(heading)), -F.cos(F.radians(heading))
    turn = [(1, 1), (1, -1), (-1, -1), (-1, 1)]
    return F.array(*[F.struct((cx + a * ux * w / 2 - b * uy * h / 2).alias("x"), (cy + a * uy * w / 2 + b * ux * h / 2).alias("y")) for a, b in turn])


def signed_area(points: Column) -> Column:
    """Shoelace formula over an array of (x, y)."""
    n = F.size(points)
    index = F.sequence(F.lit(0), n - 1)
    cross = F.transform(index, lambda i: F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, x: s + x) / 2


def valid(points: Column) -> Column:
    """Four finite corners with an area."""
    finite = F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    return F.coalesce((F.size(points) == 4) & finite & (F.abs(signed_area(points)) > 0), F.lit(False))


def bounds(points: Column) -> Column:
    """x1, y1, x2, y2 of the axis-aligned box around the points."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area shared by two axis-aligned boxes given as cx, cy, w, h."""
    def side(c: str, s: str) -> Column:
        low = F.greatest(a[c] - a[s] / 2, b[c] - b[s] / 2)
        return F.greatest(F.least(a[c] + a[s] / 2, b[c] + b[s] / 2) - low, F.lit(0.0))

    return side("cx", "w") * side("cy", "h")


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Of axis-aligned boxes; 0 if neither has an area."""
    both = overlap(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def long_side_first(df: DataFrame) -> DataFrame:
    """df with w >= h; boxes whose sides change places are turned by 90 degrees."""
    turned = F.col("w") < F.col("h")
    return df.withColumns({"w": F.greatest("w", "h"), "h": F.least("w", "h"), "heading": F.when(turned, F.pmod(F.col("heading") + 90.0, F.lit(360.0))).otherwise(F.col("heading"))})


def at_edge(cx: Column, cy: Column, half: Column, width: float, height: float, most: float, margin: float) -> Column:
    """Whether a box, taken as a square of that half side but at most `most`, comes within the margin of the picture's border."""
    h = F.least(half, F.lit(most))
    return F.least(cx - h, width - cx - h, cy - h, height - cy - h) <= margin
