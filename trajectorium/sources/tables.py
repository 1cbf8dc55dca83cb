"""Readers and writers of tracking tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import object_ids, to_long, to_wide
from .lines import cell, numbered, top

RESULT = ["cx", "cy", "w", "h", "heading"]
_ADAPTERS: dict[str, tuple[Callable[[list[str]], bool], Callable[[SparkSession, str], DataFrame]]] = {}


def register(name: str, fits: Callable[[list[str]], bool], read: Callable[[SparkSession, str], DataFrame]) -> None:
    """Adds a format: fits(columns of the header) and read(spark, path)."""
    _ADAPTERS[name] = (fits, read)


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def sniff(spark: SparkSession, path: str) -> str:
    """The first registered format that fits the header."""
    columns = header(spark, path)
    for name, (fits, _) in _ADAPTERS.items():
        if fits(columns):
            return name
    raise ValueError(f"no format fits the columns {columns}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return _ADAPTERS[sniff(spark, path)][1](spark, path)


def read_result(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A wide result table as frame, tid, cx, cy, w, h, heading. Strict: frames that repeat, are negative or fractional, columns that lack and a table without a box are errors. Else such rows and cells, and boxes without an area, are left out."""
    raw = spark.read.option("header", True).csv(path)
    ids = object_ids(raw.columns)
    values = [v for v in RESULT if f"{v}0" in raw.columns]
    lack = [f"{v}{i}" for i in ids for v in values if f"{v}{i}" not in raw.columns] + [c for c in ["frame"] if c not in raw.columns]
    if lack or not ids or len(values) < 4:
        raise ValueError(f"columns lack: {lack or RESULT}")
    number = lambda c: F.when(~F.isnan(F.expr(f"try_cast(`{c}` AS double)")), F.expr(f"try_cast(`{c}` AS double)"))
    wide = raw.select(number("frame").alias("_f"), *[number(f"{v}{i}").alias(f"{v}{i}") for i in ids for v in values])
    whole = (F.col("_f") >= 0) & (F.col("_f") == F.floor("_f"))
    if strict:
        bad, n, distinct, boxes = wide.agg(F.count_if(~F.coalesce(whole, F.lit(False))), F.count("*"), F.countDistinct("_f"), F.count_if(F.coalesce(*[F.col(f"w{i}") for i in ids]).isNotNull())).first()
        if bad or n != distinct or not boxes:
            raise ValueError(f"{bad} frames are not whole numbers from 0, {n - distinct} repeat, {boxes} rows have a box")
    long = to_long(wide.where(whole).withColumn("frame", F.col("_f").cast("long")).drop("_f"), values)
    return long if strict else long.where((F.col("w") > 0) & (F.col("h") > 0) & F.col("cx").isNotNull() & F.col("cy").isNotNull())


def write_result(long: DataFrame, path: str, ids: list[int]) -> None:
    """The inverse of read_result: one row for each frame, headings in [0, 360), six decimals."""
    text = {v: F.format_string("%.6f", F.pmod(v, F.lit(360.0)) if v == "heading" else F.col(v)) for v in RESULT}
    wide = to_wide(long.select("frame", "tid", *[F.when(F.col(v).isNotNull(), x).alias(v) for v, x in text.items()]), ids, RESULT)
    wide.orderBy("frame").write.option("header", True).csv(path)


def read_pose(spark: SparkSession, path: str) -> DataFrame:
    """track, frame_idx, <point>.x, <point>.y as frame, track (its trailing digits), point, x, y."""
    raw = spark.read.option("header", True).csv(path)
    points = [c[:-2] for c in raw.columns if c.endswith(".x") and f"{c[:-2]}.y" in raw.columns]
    cell = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    each = F.array(*[F.struct(F.lit(p).alias("point"), cell(f"{p}.x").alias("x"), cell(f"{p}.y").alias("y")) for p in points])
    ident = F.expr(r"try_cast(regexp_extract(track, '(\\d+)$', 1) AS bigint)")
    return raw.select(F.expr("try_cast(frame_idx AS bigint)").alias("frame"), ident.alias("track"), F.explode(each).alias("_x")).select("frame", "track", "_x.*")


def read_headed_pose(spark: SparkSession, path: str) -> DataFrame:
    """A pose table under a header of three lines (scorer, points, coordinates) or four (with individuals before the points) as frame, individual (null without that line), point, x, y, likelihood.

    Frames are in the first column, or, where the first three name an image, the
    rows' order from 0 over all files by path, of which the first has the header.
    """
    lines = [line.split(",") for line in top(spark, path, 5)]
    many = len(lines) > 1 and lines[1][0].strip().lower() == "individuals"
    n = 4 if many else 3
    if len(lines) < n:
        raise ValueError(f"a header of {n} lines is wanted")
    width = 3 if len(lines) > n and lines[n][0].strip() == "labeled-data" else 1
    point, coordinate = lines[n - 2], lines[n - 1]
    keys: dict[tuple[str | None, str], dict[str, int]] = {}
    for k in range(width, len(coordinate)):
        keys.setdefault((lines[1][k].strip() if many else None, point[k].strip()), {})[coordinate[k].strip().lower()] = k
    number = lambda k: cell(k) if k is not None else F.lit(None).cast("double")
    each = F.array(*[F.struct(F.lit(i).cast("string").alias("individual"), F.lit(p).alias("point"), *[number(c.get(v)).alias(v) for v in ("x", "y", "likelihood")]) for (i, p), c in keys.items()])
    rows = numbered(spark, path, n, every=False)
    frame = F.col("row") if width == 3 else cell(0).cast("long")
    return rows.select(frame.alias("frame"), F.explode(each).alias("_x")).select("frame", "_x.*")


def write_detections(det: DataFrame, path: str) -> None:
    """One row for each frame and det_index, sorted by frame within each file, so that a range of frames reads few row groups."""
    det.repartitionByRange("frame").sortWithinPartitions("frame", "det_index").write.parquet(path)


def read_detections(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The detections of a table, of the frames from first to last."""
    rows = spark.read.parquet(path)
    rows = rows if first is None else rows.where(F.col("frame") >= first)
    return rows if last is None else rows.where(F.col("frame") <= last)


def read_centroids(spark: SparkSession, path: str, most_missing: float = 0.5) -> DataFrame:
    """x0, y0, x1, ... as frame (the number of the row over all files by path), tid, x, y, without animals of which more than that share is missing."""
    names = [c.strip() for c in top(spark, path, 1)[0].split(",")]
    ids = sorted(int(m[1]) for c in names if (m := re.fullmatch(r"x(\d+)", c)))
    cells = numbered(spark, path, 1).select(F.col("row").alias("_i"), *[cell(names.index(f"{a}{i}")).alias(f"{a}{i}") for i in ids for a in "xy"])
    lack = cells.agg(*[F.avg((F.col(f"x{i}").isNull() | F.isnan(f"x{i}")).cast("double")).alias(str(i)) for i in ids]).first()
    kept = [i for i in ids if lack[str(i)] <= most_missing]
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("tid"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in kept])
    return cells.select(F.col("_i").alias("frame"), F.explode(each).alias("_x")).select("frame", "_x.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label lines (class and four corners as parts of the image's size) as stem, klass, x0, y0, ..., x3, y3; lines of another form are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("stem"), parts.alias("_p")).where(F.size("_p") == 9)
    number = lambda k: F.expr(f"try_cast(_p[{k}] AS double)")
    rows = rows.select("stem", F.expr("try_cast(_p[0] AS bigint)").alias("klass"), *[number(2 * i + j + 1).alias(f"{c}{i}") for i in range(4) for j, c in enumerate("xy")])
    return rows.dropna()


def read_reasons(spark: SparkSession, path: str, schema: str, column: str = "reasons") -> DataFrame:
    """A table whose reasons, joined by a vertical bar, become an array; none: an empty one."""
    text = F.coalesce(F.col(column), F.lit(""))
    return spark.read.schema(schema).option("header", True).csv(path).withColumn(column, F.filter(F.split(text, r"\|"), lambda x: x != ""))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all of these are numbers."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def metrics(row: DataFrame) -> DataFrame:
    """metric, value for each column of a table of one row."""
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(each).alias("_x")).select("_x.*")


def read_metrics(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One row with these metrics of a metric, value table; an error if one lacks."""
    raw = spark.read.schema("metric string, value double").option("header", True).csv(path).where(F.col("metric").isin(names))
    found = {r["metric"] for r in raw.select("metric").distinct().collect()}  # as many as names at most
    if set(names) - found:
        raise ValueError(f"metrics lack: {sorted(set(names) - found)}")
    return raw.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


register("result", lambda c: "frame" in c and "cx0" in c, read_result)
register("pose", lambda c: {"track", "frame_idx"} <= set(c), read_pose)
register("centroids", lambda c: "x0" in c and "y0" in c, read_centroids)
