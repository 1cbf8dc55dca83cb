"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """links: a, b of one integer type. Returns node, component for every node of a link: the smallest node reachable.

    Each round, first every node's larger neighbours and then its smaller ones
    are linked to the smallest node it knows. Links shrink to stars around the
    components' smallest nodes in a few rounds. Sums and joins run on tables in
    the shared folder; nothing is collected but counts. A giant component's star
    has all its links at one node: sums are combined before they are shuffled,
    and each join is one of a table of links with a table of one row for each
    node, read from files, which Spark broadcasts while it is small and of which
    it splits the skewed partitions beyond that. Tables of earlier rounds go.
    """
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n = now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # of the larger neighbours to the smallest: a link's lower end is its smaller one, so only b's larger neighbours are in the table as they stand
        large = now.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "links")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        count = after.count()
        same = count == n and after.join(now, ["a", "b"], "left_anti").isEmpty()
        discard(now, least, large, low)
        now, n = after, count
        if same:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
