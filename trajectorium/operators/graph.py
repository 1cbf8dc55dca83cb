"""Graphs as tables of links: connected components and contracted chains, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that is reachable) for every node of a link. links: a, b of one type; direction doesn't matter, a node linked with itself is alone.

    In each round a node takes the smallest component among its neighbours, then
    the component of the node of that name, so distances halve. Rounds are tables
    in the shared folder; a count of changed rows comes to the driver.
    """
    a, b = F.col("a"), F.col("b")
    both = materialize(links.select(a, b).unionByName(links.select(b.alias("a"), a.alias("b"))).distinct(), "both", dealt=True)
    now = materialize(both.groupBy(a.alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "components", dealt=True)
    while True:
        seen = both.join(now.withColumnsRenamed({"node": "b", "component": "c"}), "b").groupBy(a.alias("node")).agg(F.min("c").alias("c"))
        low = now.join(seen, "node").select("node", F.least("component", "c").alias("c"), F.col("component").alias("old"))
        jump = now.select(F.col("node").alias("c"), F.col("component").alias("far"))
        new = materialize(low.join(jump, "c").select("node", F.least("c", "far").alias("component"), "old"), "components", dealt=True)
        changed = new.where("component <> old").count()
        discard(now)
        now = new.drop("old")
        now._trajectorium_path = new._trajectorium_path
        if not changed:
            discard(both)
            return now


def chains(links: DataFrame) -> DataFrame:
    """node, chain (its first node) of every node of a link, where each node has at most one link in and one out and there is no circle. links: a, b (a before b). Pointers to the node before are doubled until all point to a first node: the logarithm of the longest chain in rounds."""
    now = materialize(links.select(F.col("b").alias("node"), F.col("a").alias("to")), "chains", dealt=True)
    while True:
        further = now.select(F.col("node").alias("to"), F.col("to").alias("before"))
        new = materialize(now.join(further, "to", "left").select("node", F.coalesce("before", "to").alias("to"), F.col("before").isNotNull().alias("moved")), "chains", dealt=True)
        moved = new.where("moved").count()
        discard(now)
        now = new
        if not moved:
            break
    first = now.select(F.col("to").alias("node"), F.col("to").alias("chain")).distinct()
    return now.select("node", F.col("to").alias("chain")).unionByName(first)
