"""Wide and long tables, relabelling, densifying."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def object_ids(columns: list[str], prefix: str = "cx") -> list[int]:
    """Ids found in column names; they have to run from 0."""
    ids = sorted(int(m[1]) for c in columns if (m := re.fullmatch(rf"{prefix}(\d+)", c)))
    if ids != list(range(len(ids))):
        raise ValueError(f"ids must be consecutive from 0, not {ids}")
    return ids


def to_wide(long: DataFrame, ids: list[int], values: list[str], ident: str = "tid", frame: str = "frame") -> DataFrame:
    """One row per frame with a column <value><id> for each; one aggregation, its columns known beforehand."""
    return long.groupBy(frame).agg(*[F.max(F.when(F.col(ident) == i, F.col(v))).alias(f"{v}{i}") for i in ids for v in values])


def to_long(wide: DataFrame, values: list[str], ident: str = "tid", frame: str = "frame") -> DataFrame:
    """The inverse of to_wide: one row per frame and id that has any value."""
    ids = object_ids(wide.columns, values[0])
    each = F.array(*[F.struct(F.lit(i).cast("long").alias(ident), *[F.col(f"{v}{i}").alias(v) for v in values]) for i in ids])
    return wide.select(frame, F.explode(each).alias("_x")).select(frame, "_x.*").where(F.coalesce(*[F.col(v) for v in values]).isNotNull())


def dense(df: DataFrame, frame: str = "frame", by: list[str] = ()) -> DataFrame:
    """df and a row for each frame from 0 to the last of each `by` that it lacks."""
    last = df.groupBy(*by).agg(F.max(frame).alias("m")) if by else df.agg(F.max(frame).alias("m"))
    return last.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias(frame)).join(df, [*by, frame], "left")


def corner_table(tracks: DataFrame, ids: list[int], frame: str = "frame") -> DataFrame:
    """position, x0<id>, y0<id>, ..., x3<id>, y3<id> and c<id> (the heading) for each id: one row per frame. tracks: corners (array of x, y), heading."""
    each = tracks.select(F.col(frame).alias("position"), "tid", *[F.get("corners", F.lit(k))[c].alias(f"{c}{k}") for k in range(4) for c in "xy"], F.col("heading").alias("c"))
    return to_wide(each, ids, [f"{c}{k}" for k in range(4) for c in "xy"] + ["c"], frame="position")


def full_outer(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both tables, together where their keys agree."""
    return a.join(b, key, "full")


def frame_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of a, and side: both, or first where b lacks them."""
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


def keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def swapped(a: int, b: int, ident: Column, frame: Column, start: int, end: int) -> Column:
    """ident with a and b exchanged on frames start <= frame < end."""
    inside = (frame >= start) & (frame < end)
    return F.when(inside & (ident == a), F.lit(b)).when(inside & (ident == b), F.lit(a)).otherwise(ident)


def relabelled(df: DataFrame, mapping: dict[int, int], start: int, end: int, ident: str = "tid") -> DataFrame:
    """df with ids mapped on frames start..end; the mapping has to be a permutation."""
    if set(mapping) != set(mapping.values()):
        raise ValueError("the mapping is no permutation")
    table = F.create_map(*[F.lit(x).cast("long") for kv in mapping.items() for x in kv])
    new = F.coalesce(F.element_at(table, F.col(ident).cast("long")), F.col(ident).cast("long"))
    return df.withColumn(ident, F.when(F.col("frame").between(start, end), new).otherwise(F.col(ident).cast("long")))


def front_rear(df: DataFrame) -> DataFrame:
    """df with the ends of each box along its heading and their middle."""
    ux, uy = F.sin(F.radians("heading")) * F.col("w") / 2, -F.cos(F.radians("heading")) * F.col("w") / 2
    return df.withColumns({"front_x": F.col("cx") + ux, "front_y": F.col("cy") + uy, "rear_x": F.col("cx") - ux, "rear_y": F.col("cy") - uy})


def merged_reasons(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both tables' keys with the union of their reasons, a's first."""
    none = F.array().cast("array<string>")
    both = a.withColumnRenamed("reasons", "_a").join(b.withColumnRenamed("reasons", "_b"), key, "full")
    return both.select(key, F.array_union(F.coalesce("_a", none), F.coalesce("_b", none)).alias("reasons"))


def natural_key(name: Column) -> Column:
    """A text that sorts like name with its numbers compared as numbers, of up to 20 digits."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(F.lower(x))), "")


def trailing_number(column: str) -> Column:
    """The digits at the end of a name; a name without any is an error."""
    digits = F.regexp_extract(column, r"([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no number at the end of "), F.col(column))).cast("long"))


def number_text(x: Column) -> Column:
    """Whole numbers bare, others with six decimals."""
    return F.when(x == F.floor(x), F.format_string("%d", F.floor(x))).otherwise(F.format_string("%.6f", x))
