"""Operators along a track: every one is a window over (track, frame) or a join on it, so tracks are spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles


def _along(key: list[str], order: str = "frame"):
    return Window.partitionBy(*key).orderBy(order)


def islands(df: DataFrame, key: list[str], order: str = "frame", max_gap: int = 1) -> DataFrame:
    """df with island, counted from 1 in each key: a new one begins where order grows by more than max_gap."""
    w = _along(key, order)
    step = F.col(order) - F.lag(order).over(w)
    return df.withColumn("_new", F.when(step <= max_gap, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def runs(df: DataFrame, key: list[str], order: str = "frame", max_gap: int = 1) -> DataFrame:
    """One row per island: start, end, how many rows."""
    return islands(df, key, order, max_gap).groupBy(*key, "island").agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame"), F.count("*").alias("n"))


def short_runs(df: DataFrame, key: list[str], most: int, order: str = "frame", max_gap: int = 1) -> DataFrame:
    """df with erased: whether the row's island has at most `most` rows."""
    w = Window.partitionBy(*key, "island")
    return islands(df, key, order, max_gap).withColumn("erased", F.count("*").over(w) <= most)


def jumps(df: DataFrame, key: list[str], limit: float) -> DataFrame:
    """df with jump: moved more than limit since the frame just before. Only the later row of a pair is flagged."""
    w = _along(key)
    moved = F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w))
    next_ = F.col("frame") == F.lag("frame").over(w) + 1
    return df.withColumn("jump", F.coalesce(next_ & (moved > limit), F.lit(False)))


def missing(df: DataFrame, key: list[str]) -> DataFrame:
    """The (key, frame) that a track lacks between its first and last frame. Generated from the gaps, not from the whole range."""
    gap = df.select(*key, "frame", F.lead("frame").over(_along(key)).alias("next")).where("next > frame + 1")
    return gap.select(*key, F.explode(F.sequence(F.col("frame") + 1, F.col("next") - 1)).alias("frame"))


def filled(df: DataFrame, key: list[str], linear: list[str], circular: list[str] = (), edges: bool = False) -> DataFrame:
    """df and its missing rows, with values interpolated along the frame; edges: null values before the first and after the last known one take that."""
    rows = df.unionByName(missing(df, key), allowMissingColumns=True)
    w = _along(key)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = lambda c, o: F.when(F.col(c).isNotNull(), F.struct(F.col("frame").alias("f"), F.col(c).alias("v")))
    for c in [*linear, *circular]:
        rows = rows.withColumn(f"_{c}a", F.last(known(c, 0), ignorenulls=True).over(before)).withColumn(f"_{c}b", F.first(known(c, 0), ignorenulls=True).over(after))

    def value(c: str) -> Column:
        a, b = F.col(f"_{c}a"), F.col(f"_{c}b")
        alpha = (F.col("frame") - a["f"]) / (b["f"] - a["f"])
        between = angles.interpolate(a["v"], b["v"], alpha) if c in circular else a["v"] + alpha * (b["v"] - a["v"])
        out = F.when(F.col(c).isNotNull(), F.col(c)).when(a.isNotNull() & b.isNotNull(), between)
        return out.otherwise(F.coalesce(a["v"], b["v"])) if edges else out

    return rows.select(*key, "frame", *[value(c).alias(c) for c in [*linear, *circular]])


def spikes(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose frame neighbours are both there, from which the track turns back, and whose midpoint would shorten the longer step. With the midpoint mx, my."""
    w = _along(key)
    p, n = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    rows = df.select(*key, "frame", "cx", "cy", *[f(c).alias(f"{k}{c}") for k, f in (("p", p), ("n", n)) for c in ("frame", "cx", "cy")])
    back = (F.col("cx") - F.col("pcx")) * (F.col("ncx") - F.col("cx")) + (F.col("cy") - F.col("pcy")) * (F.col("ncy") - F.col("cy"))
    longest = F.greatest(F.hypot(F.col("cx") - F.col("pcx"), F.col("cy") - F.col("pcy")), F.hypot(F.col("ncx") - F.col("cx"), F.col("ncy") - F.col("cy")))
    half = F.hypot(F.col("ncx") - F.col("pcx"), F.col("ncy") - F.col("pcy")) / 2
    found = rows.where((F.col("pframe") == F.col("frame") - 1) & (F.col("nframe") == F.col("frame") + 1) & (back < 0) & (half < longest))
    return found.select(*key, "frame", ((F.col("pcx") + F.col("ncx")) / 2).alias("mx"), ((F.col("pcy") + F.col("ncy")) / 2).alias("my"), (longest - half).alias("improvement"))


def run_winners(df: DataFrame, key: list[str], by: str) -> DataFrame:
    """The best row of each island of consecutive frames: most of `by`, then the earliest."""
    w = Window.partitionBy(*key, "island").orderBy(F.desc(by), "frame")
    return islands(df, key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def bridged(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """df with `value` filled where its known neighbours along the track agree."""
    w = _along(key)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("bridged", F.coalesce(F.col(value), F.when(before == after, before)))


def sign_continuity(df: DataFrame, key: list[str]) -> DataFrame:
    """df with turned: the axis heading, flipped where it points against the one before, so that a track's axes agree."""
    w = _along(key)
    against = angles.distance(F.col("heading"), F.lag("heading").over(w)) > 90
    rows = df.withColumn("_f", F.when(against, 1).otherwise(0))
    flips = F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("turned", angles.wrap(F.col("heading") + 180.0 * (flips % 2))).drop("_f")


def null_runs(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """df with severity: the length of the row's run of nulls of value, counted in rows, not frames; 0 where it is known."""
    w = _along(key)
    rows = df.withColumn("_k", F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nulls = F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).over(Window.partitionBy(*key, "_k"))
    return rows.withColumn("severity", F.when(F.col(value).isNull(), nulls).otherwise(0).cast("long")).drop("_k")


def stable_islands(df: DataFrame, key: list[str], turn: float, least: int) -> DataFrame:
    """One row per run of at least `least` consecutive frames in which the heading turns by less than turn from one to the next."""
    w = _along(key)
    goes_on = (F.col("frame") == F.lag("frame").over(w) + 1) & (angles.distance(F.col("heading"), F.lag("heading").over(w)) < turn)
    rows = df.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "island").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def broken_order(df: DataFrame, key: list[str], order: str = "frame") -> DataFrame:
    """Rows whose order is not the one after their predecessor's: what an in-order reader has to refuse."""
    before = F.lag(order).over(_along(key, order))
    return df.withColumn("before", before).where((F.col("before").isNotNull()) & (F.col(order) != F.col("before") + 1))


def gaps(df: DataFrame, key: list[str], shorter_than: int) -> DataFrame:
    """key, before, after: the known frames around each gap of fewer missing frames than that."""
    rows = df.select(*key, F.col("frame").alias("before"), F.lead("frame").over(_along(key)).alias("after"))
    return rows.where((F.col("after") > F.col("before") + 1) & (F.col("after") - F.col("before") - 1 < shorter_than))


def between_anchors(df: DataFrame, key: list[str], value: str, edited: str) -> DataFrame:
    """df, value of edited rows taken from the line between the unedited rows around them; kept where one of these lacks."""
    w = _along(key)
    anchor = F.when(~F.col(edited), F.struct(F.col("frame").alias("f"), F.col(value).alias("v")))
    rows = df.withColumn("_a", F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(anchor, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("frame") - F.col("_a.f")) / (F.col("_b.f") - F.col("_a.f"))
    return rows.withColumn(value, F.when(F.col(edited) & F.col("_a").isNotNull() & F.col("_b").isNotNull(), line).otherwise(F.col(value))).drop("_a", "_b")
