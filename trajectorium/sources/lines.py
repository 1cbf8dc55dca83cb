"""Text tables whose rows have a number, however Spark splits their files.

A first pass counts the lines of each split, where it begins in its file; a second
one numbers lines within splits and adds what lies before. The driver holds a
number for each split. Should the second pass have other splits than the first, it
fails. Files follow each other by path, as part-files of one sorted table do. A
quoted cell can't hold a line end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

NUMBERED = "file string, split bigint, line bigint, row bigint, value string"


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines numbered from 0 within each split; a task reads a split's lines one after the other."""
    key, n = None, 0
    for b in batches:
        files, splits = (b.column(c).to_pylist() for c in ("file", "split"))
        rank = np.empty(b.num_rows, np.int64)
        for k, own in enumerate(zip(files, splits)):
            if own != key:
                key, n = own, 0
            rank[k] = n
            n += 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank)], names=[*b.schema.names, "rank"])


def numbered(spark: SparkSession, path: str, header: int = 0, every: bool = True) -> DataFrame:
    """file, split (its place in the file), line (in the file), row (over all files, header lines left out), value. header: lines at the top of each file or, if not `every`, of the first."""
    ship(spark)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    starts, before, own, seen = [], 0, 0, set()
    for r in raw.groupBy("file", "split").count().orderBy("file", "split").collect():  # a row for each split
        if r["file"] not in seen:
            own = 0
            before -= header if every or not seen else 0
            seen.add(r["file"])
        starts.append((r["file"], r["split"], own, before))
        own += r["count"]
        before += r["count"]
    ranked = raw.mapInArrow(_ranked, "file string, split bigint, value string, rank bigint")
    known = F.broadcast(spark.createDataFrame(starts, "file string, split bigint, own bigint, before bigint"))
    first = min(seen, default="")
    tops = F.lit(header) if every else F.when(F.col("file") == first, header).otherwise(0)
    lost = F.raise_error(F.lit("the files' splits changed between the passes")).cast("bigint")
    rows = ranked.join(known, ["file", "split"], "left").withColumn("line", F.coalesce("own", lost) + F.col("rank"))
    return rows.where(F.col("line") >= tops).select("file", "split", "line", (F.col("before") + F.col("rank")).alias("row"), "value")


def top(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first n lines of the first file."""
    rows = numbered(spark, path)
    first = rows.agg(F.min("file")).first()[0]
    return [r["value"] for r in rows.where((F.col("file") == first) & (F.col("line") < n)).orderBy("line").collect()]


def cell(k: int) -> Column:
    """The k-th cell of a line, a number or null."""
    return F.expr(f"try_cast(get(split(value, ','), {k}) AS double)")


def ordered(spark: SparkSession, path: str, by: str) -> DataFrame:
    """row and the columns of tables with a header line, as strings, whose column `by` must be a number that increases from row to row; a row out of order, or without a number, is an error that names it.

    Neighbours are compared within splits, in parallel; the splits' first and last values are compared on the driver.
    """
    names = top(spark, path, 1)[0].split(",")
    rows = numbered(spark, path, 1).withColumn("_at", cell(names.index(by)))
    along = Window.partitionBy("file", "split").orderBy("row")
    ends = rows.groupBy("file", "split").agg(F.min_by("_at", "row").alias("low"), F.max_by("_at", "row").alias("high"), F.min("row").alias("row")).orderBy("row").collect()
    for a, b in zip(ends, ends[1:]):
        if a["high"] is not None and b["low"] is not None and a["high"] >= b["low"]:
            raise ValueError(f"{by} is {b['low']} in row {b['row']}, after {a['high']}")
    checked = rows.withColumn("_was", F.lag("_at").over(along))
    wrong = F.raise_error(F.concat(F.lit(f"{by} doesn't increase in row "), F.col("row").cast("string"))).cast("bigint")
    good = F.when(F.col("_at").isNull() | F.coalesce(F.col("_was") >= F.col("_at"), F.lit(False)), wrong).otherwise(F.col("row"))
    return checked.select(good.alias("row"), *[F.get(F.split("value", ","), F.lit(k)).alias(c) for k, c in enumerate(names)])
