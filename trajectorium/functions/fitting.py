"""Boxes fitted to point clouds: along the first principal axis, or of the least area."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .polygons import bound

#: Variances closer than this share of the larger one give no axis, nor does a cloud of less than the least variance.
ISOTROPIC, LEAST = 1e-6, 1e-12
_FIT = "cx double, cy double, w double, h double, angle double"


def moments(points: Column) -> Column:
    """n, mx, my, xx, yy, xy of an array of (x, y): mean and covariances, by division by n."""
    n = lambda p: F.size(p).cast("double")
    total = lambda p, f: F.aggregate(p, F.lit(0.0), lambda s, q: s + f(q))
    centre = bound(points, lambda p: F.struct(p.alias("p"), (total(p, lambda q: q["x"]) / n(p)).alias("x"), (total(p, lambda q: q["y"]) / n(p)).alias("y")))
    part = lambda m, f: total(m["p"], f) / n(m["p"])

    def all_(m: Column) -> Column:
        x, y = (lambda q: q["x"] - m["x"]), (lambda q: q["y"] - m["y"])
        return F.struct(F.size(m["p"]).alias("n"), m["x"].alias("mx"), m["y"].alias("my"), part(m, lambda q: x(q) * x(q)).alias("xx"), part(m, lambda q: y(q) * y(q)).alias("yy"), part(m, lambda q: x(q) * y(q)).alias("xy"))

    return bound(centre, all_)


def principal_box(points: Column) -> Column:
    """cx, cy, w (along the first principal axis), h, angle (of that axis, degrees, from -90 to 90) of the box around an array of (x, y); null if the cloud has fewer than three points or no such axis."""

    def fit(s: Column) -> Column:
        m = s["m"]
        spread = F.sqrt((m["xx"] - m["yy"]) * (m["xx"] - m["yy"]) + 4 * m["xy"] * m["xy"])  # the variances' difference
        major = (m["xx"] + m["yy"] + spread) / 2
        angle = F.atan2(2 * m["xy"], m["xx"] - m["yy"]) / 2
        some = (m["n"] >= 3) & (major > LEAST) & (spread > F.greatest(major, F.lit(LEAST)) * ISOTROPIC)
        return F.when(some, F.struct(s["p"].alias("p"), m["mx"].alias("mx"), m["my"].alias("my"), F.cos(angle).alias("ux"), F.sin(angle).alias("uy"), F.degrees(angle).alias("angle")))

    def ends(a: Column) -> Column:
        along = F.transform(a["p"], lambda q: (q["x"] - a["mx"]) * a["ux"] + (q["y"] - a["my"]) * a["uy"])
        across = F.transform(a["p"], lambda q: (q["y"] - a["my"]) * a["ux"] - (q["x"] - a["mx"]) * a["uy"])
        low_high = lambda v, k: (F.array_min(v).alias(f"{k}0"), F.array_max(v).alias(f"{k}1"))
        return F.struct(*[a[c].alias(c) for c in ("mx", "my", "ux", "uy", "angle")], *low_high(along, "a"), *low_high(across, "b"))

    def box(e: Column) -> Column:
        a, b = (e["a0"] + e["a1"]) / 2, (e["b0"] + e["b1"]) / 2
        return F.when(e["angle"].isNotNull(), F.struct((e["mx"] + e["ux"] * a - e["uy"] * b).alias("cx"), (e["my"] + e["uy"] * a + e["ux"] * b).alias("cy"), (e["a1"] - e["a0"]).alias("w"), (e["b1"] - e["b0"]).alias("h"), e["angle"].alias("angle")))

    return bound(bound(bound(F.struct(points.alias("p"), moments(points).alias("m")), fit), ends), box)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, by a sweep along x."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def side(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1:
                a, b = out[-1] - out[-2], q - out[-2]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(side(p) + side(p[::-1]))


def least_box(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """cx, cy, w, h, angle of the box of the least area around points, w the longer side; one side lies along an edge of the hull. The first edge on ties."""
    ring = hull(np.asarray(points, float).reshape(-1, 2))
    turn = np.roll(ring, -1, 0) - ring
    length = np.hypot(*turn.T)
    axis = turn[length > 0] / length[length > 0, None] if (length > 0).any() else np.array([[1.0, 0.0]])
    along, across = ring @ axis.T, ring @ np.stack((-axis[:, 1], axis[:, 0]))
    size = np.stack((np.ptp(along, 0), np.ptp(across, 0)))
    k = int(np.argmin(size.prod(0).round(9)))
    a, b = (along[:, k].max() + along[:, k].min()) / 2, (across[:, k].max() + across[:, k].min()) / 2
    ux, uy = axis[k]
    w, h, angle = *size[:, k], np.degrees(np.arctan2(uy, ux))
    if h > w:
        w, h, angle = h, w, angle + 90
    return float(ux * a - uy * b), float(uy * a + ux * b), float(w), float(h), float((angle + 90) % 180 - 90)


def fitted(df: DataFrame, points: str = "points", mode: str = "pca", key: list[str] = ("frame", "blob_index")) -> DataFrame:
    """key, cx, cy, w, h, angle of each row's point cloud; mode pca or min_area. Clouds without a principal axis get the box of the least area. Fewer than three points, or one that isn't finite, is an error.

    Principal boxes are expressions; only the other rows go to Python, in Arrow batches.
    """
    if mode not in ("pca", "min_area"):
        raise ValueError(f"no such mode: {mode}")
    p = F.col(points)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce((F.size(p) >= 3) & F.forall(p, lambda q: number(q["x"]) & number(q["y"])), F.lit(False))
    rows = df.select(*key, F.when(good, p).otherwise(F.raise_error(F.lit("a box needs three points or more, all finite")).cast(df.schema[points].dataType)).alias("_p"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [least_box(np.array([(q["x"], q["y"]) for q in c])) for c in pdf["_p"]]
            yield pd.concat([pdf[list(key)].reset_index(drop=True), pd.DataFrame(found, columns=["cx", "cy", "w", "h", "angle"])], axis=1)

    if mode == "min_area":
        return rows.mapInPandas(run, f"{kinds}, {_FIT}")
    rows = rows.withColumn("_b", principal_box(F.col("_p")))
    rest = rows.where("_b IS NULL").drop("_b").mapInPandas(run, f"{kinds}, {_FIT}")
    return rows.where("_b IS NOT NULL").select(*key, "_b.*").unionByName(rest)
