"""Summaries: robust bounds, trimmed means, modes, retention curves, apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iqr_bounds(df: DataFrame, value: str, low: float = 1.5, high: float = 1.5) -> DataFrame:
    """One row lo, hi: quartiles widened by shares of their distance; without rows, all numbers."""
    q = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    wide = F.col("q")[1] - F.col("q")[0]
    return q.select(F.coalesce(F.col("q")[0] - low * wide, F.lit(float("-inf"))).alias("lo"), F.coalesce(F.col("q")[1] + high * wide, F.lit(float("inf"))).alias("hi"))


def trimmed_mean(df: DataFrame, value: str) -> DataFrame:
    """The mean of the values inside the IQR bounds, of all if none is."""
    b = F.broadcast(iqr_bounds(df, value))  # one row
    inside = F.when(F.col(value).between(F.col("lo"), F.col("hi")), F.col(value))
    return df.join(b).agg(F.coalesce(F.avg(inside), F.avg(value)).alias("trimmed_mean"))


def modal_count(df: DataFrame, frame: str, ident: str) -> DataFrame:
    """The most common number of distinct ids in a frame; the smallest on ties."""
    counts = df.groupBy(frame).agg(F.countDistinct(ident).alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    return counts.agg(F.max_by("n", F.struct("c", -F.col("n"))).alias("n_individuals"))


def retention(df: DataFrame, value: str, thresholds: list[float], share: float = 0.95) -> DataFrame:
    """threshold, kept (the share of values of at least it), chosen: the strictest that keeps `share`, else the loosest. One pass."""
    one = df.agg(*[F.avg(F.when(F.col(value) >= t, 1.0).otherwise(0.0)).alias(f"t{k}") for k, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("kept")) for k, t in enumerate(thresholds)])
    best = F.coalesce(F.array_max(F.transform(F.filter("r", lambda x: x["kept"] >= share), lambda x: x["threshold"])), F.lit(float(min(thresholds))))
    return one.select(rows.alias("r")).withColumn("best", best).select(F.explode("r").alias("x"), "best").select("x.threshold", "x.kept", (F.col("x.threshold") == F.col("best")).alias("chosen"))


def delete_ratio(rows: DataFrame, key: str, flag: Column, num: int, den: int) -> DataFrame:
    """Per key: flagged, total, and whether flagged / total >= num / den, in whole numbers."""
    out = rows.groupBy(key).agg(F.sum(F.when(flag, 1).otherwise(0)).cast("long").alias("flagged"), F.count("*").alias("total"))
    return out.withColumn("expand", F.col("flagged") * den >= F.col("total") * num)


def apportion(buckets: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Shares of total by largest remainder, at most each bucket's size; ties to the lower key. buckets has one row per bucket."""
    everything = Window.partitionBy()
    whole = F.sum(size).over(everything)
    rows = buckets.withColumn("_n", F.col(size) * F.lit(total)).withColumn("_all", whole)
    rows = rows.withColumn("_floor", F.floor(F.col("_n") / F.col("_all"))).withColumn("_rest", F.col("_n") - F.col("_floor") * F.col("_all"))
    rows = rows.withColumn("_left", F.lit(total) - F.sum("_floor").over(everything)).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_rest"), key)))
    return rows.select(key, size, F.least(F.col("_floor") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0), F.col(size)).cast("long").alias("allocated"))


def centroids(frags: DataFrame, key: str, vector: str, median: bool = False) -> DataFrame:
    """key, position, value: the mean or median vector of each key, component by component."""
    each = frags.select(key, F.posexplode(vector).alias("position", "_v"))
    value = F.percentile("_v", F.lit(0.5)) if median else F.avg("_v")
    return each.groupBy(key, "position").agg(value.alias("value"))


def median_bounds(df: DataFrame, value: str, low: float = 1.5, high: float = 1.5) -> DataFrame:
    """iqr_bounds, moved outwards where the median would lie outside."""
    q = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    a, m, b = (F.col("q")[k] for k in range(3))
    return q.select(F.coalesce(F.least(m, a - low * (b - a)), F.lit(float("-inf"))).alias("lo"), F.coalesce(F.greatest(m, b + high * (b - a)), F.lit(float("inf"))).alias("hi"))


def summary(df: DataFrame, value: str, ident: str) -> DataFrame:
    """One row: lo, hi, q1, median, q3, mean, and the rows of the extremes: the first id of the least, the last of the most."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    lo, hi = F.min(F.struct(F.col(value).alias("v"), F.col(ident).alias("i"))), F.max(F.struct(F.col(value).alias("v"), F.col(ident).alias("i")))
    out = df.where(F.col(value).isNotNull()).agg(lo.alias("a"), hi.alias("b"), q.alias("q"), F.avg(value).alias("mean"))
    return out.select(F.col("a.v").alias("lo"), F.col("b.v").alias("hi"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean", F.col("a.i").alias("lo_id"), F.col("b.i").alias("hi_id"))


def reference_scale(df: DataFrame, chain: str, value: str) -> DataFrame:
    """low, middle, high (10, 50 and 99 %) of the medians of the chains of two rows or more; of all values if there are under three such chains."""
    ends = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))
    per = df.groupBy(chain).agg(F.percentile(value, F.lit(0.5)).alias("m"), F.count("*").alias("n")).where("n >= 2")
    chains = per.agg(F.percentile("m", ends).alias("c"), F.count("*").alias("k"))
    q = chains.join(df.agg(F.percentile(value, ends).alias("v"))).select(F.when(F.col("k") >= 3, F.col("c")).otherwise(F.col("v")).alias("q"))  # one row each
    return q.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high"))
