"""Deterministic samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_interval(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) that depends on seed and parts alone: the first 52 bits of the sha256 of their text, joined by slashes; a null part is empty."""
    text = F.concat_ws("/", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def split_by_group(df: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """df with split train or val; a group is never in both. No shuffle."""
    return df.withColumn("split", F.when(unit_interval(seed, F.col(group)) < share, "val").otherwise("train"))


def evenly(df: DataFrame, order: str, count: int) -> DataFrame:
    """At most count rows, evenly over the order, the first and last among them. df is one sequence, such as a table of frames."""
    w = Window.orderBy(order)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    step = F.col("_n") - 1
    k = F.floor((2 * F.col("_i") * (count - 1) + step) / (2 * step))  # the target nearest to this row
    target = F.floor((2 * k * step + (count - 1)) / F.lit(2 * (count - 1)))
    return rows.where((F.col("_n") <= count) | (target == F.col("_i"))).drop("_i", "_n")


def even_jobs(frames: DataFrame, order: str, total: int) -> DataFrame:
    """frames with jobs: of total, floor((i+1) total / n) - floor(i total / n) for the i-th of n."""
    i = F.row_number().over(Window.orderBy(order)) - 1
    rows = frames.withColumn("_i", i).withColumn("_n", F.count("*").over(Window.partitionBy()))
    part = lambda x: F.floor(x * total / F.col("_n"))
    return rows.withColumn("jobs", (part(F.col("_i") + 1) - part(F.col("_i"))).cast("long")).drop("_i", "_n")


def top_per_group(df: DataFrame, group: str, by: str, count: int, tie: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(by), tie)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")


def overlapping_intervals(f: DataFrame, bin_size: int) -> DataFrame:
    """a < b, a_obj, b_obj: fragments (frag_id, obj_id, start_frame, end_frame) that share a frame. They meet in bins of frames, a pair in the bin of the later start only."""
    binned = f.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_frame") / bin_size), F.floor(F.col("end_frame") / bin_size))))
    side = lambda k: binned.select("_b", *[F.col(c).alias(f"{k}{n}") for c, n in (("frag_id", ""), ("obj_id", "_obj"), ("start_frame", "_s"), ("end_frame", "_e"))])
    pairs = side("a").join(side("b"), "_b").where("a < b AND a_s <= b_e AND b_s <= a_e")
    return pairs.where(F.floor(F.greatest("a_s", "b_s") / bin_size) == F.col("_b")).select("a", "b", "a_obj", "b_obj")


def reachable_split(sizes: dict[int, int], target: int, low: int | None = None, high: int | None = None) -> dict[int, int]:
    """How many groups of each size make up the validation rows. sizes: group size -> number of groups. With low and high the sum must lie in them: target if it can be made, else the least sum that can, else an error. Without, the sum next to target, the larger on a tie."""
    most = 2 * target if high is None or low is None else high  # 0 can be made, so nothing beyond twice the target is nearer
    mask = (1 << (max(most, 0) + 1)) - 1
    items = [(s, min(n, 1 << k, n - (1 << k) + 1)) for s, n in sorted(sizes.items()) for k in range(n.bit_length()) if n - (1 << k) + 1 > 0]
    reach = [1]
    for s, n in items:
        reach.append((reach[-1] | reach[-1] << (s * n)) & mask if s * n <= most else reach[-1])
    if low is None or high is None:
        below = (reach[-1] & ((1 << (target + 1)) - 1)).bit_length() - 1
        above = reach[-1] >> target
        above = target + (above & -above).bit_length() - 1 if above else None
        best = below if above is None or target - below < above - target else above
    else:
        inside = reach[-1] >> low << low
        if not inside:
            raise ValueError(f"no sum from {low} to {high} can be made")
        best = target if low <= target <= high and reach[-1] >> target & 1 else (inside & -inside).bit_length() - 1
    taken = dict.fromkeys(sizes, 0)
    for (s, n), before in zip(reversed(items), reversed(reach[:-1])):
        if not before >> best & 1:
            taken[s] += n
            best -= s * n
    return taken


def disjoint_split(rows: DataFrame, group: str, target: int, seed: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """rows with split train or val, of which val has as near to target rows as whole groups allow. Groups of one size are chosen by a hash.

    Only the histogram of group sizes goes to the driver: as many numbers as
    there are different sizes.
    """
    per = rows.groupBy(group).agg(F.count("*").alias("_size"))
    sizes = {r["_size"]: r["count"] for r in per.groupBy("_size").count().collect()}
    taken = reachable_split(sizes, target, low, high)
    many = F.create_map(*[F.lit(x).cast("long") for k in taken.items() for x in k])
    place = F.row_number().over(Window.partitionBy("_size").orderBy(unit_interval(seed, F.col(group)), group))
    val = per.where(many[F.col("_size")] > 0).withColumn("_r", place).where(F.col("_r") <= many[F.col("_size")]).select(group, F.lit("val").alias("split"))
    return rows.join(val, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def rotation(seed: str, degrees: list[int], share: float, *parts: Column) -> Column:
    """0, or with probability share one of degrees; depends on seed and parts alone."""
    some = [x for x in degrees if x]
    if not some:
        return F.lit(0)
    which = F.get(F.array(*[F.lit(x) for x in some]), F.floor(unit_interval(f"{seed}/which", *parts) * len(some)).cast("int"))
    return F.when(unit_interval(seed, *parts) < share, which).otherwise(0)
