"""Which identity is which: contact groups, silhouettes, assignment before and after a contact, safe swaps, slots."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread


def contact_groups(pairs: DataFrame) -> DataFrame:
    """frame, event_id, component_id (the smallest event_id that contacts lead to) of the pairs' detections. One group per frame, so a group is as large as one frame's contacts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf[["a_event_id", "b_event_id"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[at[:, 0]], label[at[:, 1]])
            new = label.copy()
            np.minimum.at(new, at[:, 0], low)
            np.minimum.at(new, at[:, 1], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"frame": pdf["frame"].iloc[0], "event_id": ids, "component_id": ids[label]})

    return spread(pairs.select("frame", "a_event_id", "b_event_id"), "frame").groupBy("frame").applyInPandas(run, "frame bigint, event_id bigint, component_id bigint")


#: Points of a block of silhouette() at most, and rows of a strip.
MOST_BLOCK, STRIP = 16384, 64
#: Part of the squared lengths below which a squared distance is taken from the differences, and how many such pairs at once.
CLOSE, AT_ONCE = 1e-3, 8192


def distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of u from all of v, by one product of matrices; those of close pairs, where that would lose digits, by their differences."""
    with np.errstate(over="ignore", invalid="ignore"):
        long = (u * u).sum(1)[:, None] + (v * v).sum(1)
        square = long - 2 * (u @ v.T)
        i, j = np.nonzero(~((square > CLOSE * long) & (long < 1e300)))
        for s in range(0, len(i), AT_ONCE):
            x, y = i[s : s + AT_ONCE], j[s : s + AT_ONCE]
            square[x, y] = ((u[x] - v[y]) ** 2).sum(1)
        return np.sqrt(square)


def silhouette(points: DataFrame, ident: str, label: str, vector: str, block: int = 2048) -> DataFrame:
    """ident, s of every point by Euclidean distance: (b - a) / max(a, b), 0 for the only one of its label. null if there is one label only.

    Points are dealt by their id into blocks of about `block` points, of more if they are many, up to MOST_BLOCK; each pair
    of blocks is one group, worked through in strips, and leaves one row per
    point and label, so memory is bounded however many points there are.
    """
    many = points.count()
    # each point goes to every block once, so blocks grow with the points while there are enough groups for all tasks
    block = max(block, min(MOST_BLOCK, many // 16))
    blocks = max(1, -(-many // block))
    p = points.select(F.col(ident).alias("i"), F.col(label).alias("l"), F.col(vector).alias("v"), F.pmod(F.xxhash64(ident), F.lit(blocks)).alias("b"))
    side = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = p.select("*", side.alias("o"), F.lit(0).alias("s")).withColumnRenamed("b", "x").withColumnRenamed("o", "y")
    right = p.select("*", side.alias("o"), F.lit(1).alias("s")).withColumnRenamed("b", "y").withColumnRenamed("o", "x")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["s"] == k] for k in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame({"i": [], "l": [], "m": [], "d": [], "n": []})
        u, v = (np.stack(k["v"].to_numpy()).astype(float) for k in (a, b))
        names, which = np.unique(b["l"].to_numpy(), return_inverse=True)
        member = np.zeros((len(b), len(names)))
        member[np.arange(len(b)), which] = 1
        far = np.concatenate([distances(u[s : s + STRIP], v) @ member for s in range(0, len(u), STRIP)])
        out = []
        for k, m in enumerate(names):
            out.append(pd.DataFrame({"i": a["i"].to_numpy(), "l": a["l"].to_numpy(), "m": m, "d": far[:, k], "n": (which == k).sum() - np.isin(a["i"], b["i"][which == k])}))
        return pd.concat(out)

    cells = spread(left.unionByName(right.select(left.columns)), "x", "y").groupBy("x", "y").applyInPandas(run, "i bigint, l bigint, m bigint, d double, n bigint")
    to = cells.groupBy("i", "l", "m").agg(F.try_divide(F.sum("d"), F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    each = to.groupBy("i", "l").agg(F.max(F.when(F.col("l") == F.col("m"), F.coalesce("mean", F.lit(0.0)))).alias("a"), F.max(F.when(F.col("l") == F.col("m"), F.col("n"))).alias("own"), F.min(F.when(F.col("l") != F.col("m"), F.col("mean"))).alias("b"))
    s = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return each.select(F.col("i").alias(ident), F.when(F.col("b").isNull(), F.lit(None)).when(F.col("own") == 0, 0.0).otherwise(s).alias("s"))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x - y, F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def two_roster_decision(costs: DataFrame, swap_ratio: float = 0.5, identity_limit: float = 5.0) -> DataFrame:
    """costs: key, c11, c12, c21, c22 (before i to after j). decision: swap if its sum is at most swap_ratio of the identity's, identity if its largest part is below the limit and its sum no larger than the swap's, else abstain."""
    same, swap = F.col("c11") + F.col("c22"), F.col("c12") + F.col("c21")
    what = F.when(swap <= swap_ratio * same, "swap").when((same <= swap) & (F.greatest("c11", "c22") < identity_limit), "identity").otherwise("abstain")
    return costs.withColumn("decision", F.when(same.isNull() | swap.isNull(), "abstain").otherwise(what))


def roster_decision(costs: DataFrame, swap_ratio: float = 0.5, identity_limit: float = 5.0, most: int = 3) -> DataFrame:
    """key, decision, mapping, best, identity_cost, second of each contact. costs: key, n, cost (array of n rows of n: before i to after j).

    All orders of up to `most` ids are tried, the identity first, so that it
    holds on ties. swap: the best isn't the identity and costs at most swap_ratio of the
    identity's and of the second best; identity: the best is, and its largest part is
    below the limit. Else, as for other numbers of ids or costs that lack, the
    decision says why none is made, and the mapping is the identity.
    """
    n = F.col("n")
    tried = F.lit(None)
    for size in range(2, most + 1):
        options = [F.struct(aggregate_sum([F.col("cost")[i][j] for i, j in enumerate(p)]).alias("total"), F.lit(k).alias("k"), F.array(*[F.lit(j) for j in p]).alias("to"), F.greatest(*[F.col("cost")[i][j] for i, j in enumerate(p)]).alias("largest")) for k, p in enumerate(permutations(range(size)))]
        tried = F.when(n == size, F.array(*options)).otherwise(tried)
    rows = costs.withColumn("_all", tried).withColumn("_sorted", F.array_sort("_all"))
    best, same, second = F.col("_sorted")[0], F.col("_all")[0], F.col("_sorted")[1]
    lacks = F.col("_all").isNotNull() & F.exists(F.flatten("cost"), lambda x: x.isNull())
    swap = best["k"] != 0
    what = (
        F.when(F.col("_all").isNull(), "roster_invalid")
        .when(lacks, "centroid_missing")
        .when(swap & (best["total"] > swap_ratio * F.least(same["total"], second["total"])), "gate_cost_ratio")
        .when(~swap & (best["largest"] >= identity_limit), "gate_abs_dist")
        .when(swap, "swap")
        .otherwise("identity")
    )
    rows = rows.withColumn("decision", what)
    kept = F.when(F.col("decision") == "swap", best["to"]).otherwise(F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda x: x)).otherwise(F.array().cast("array<int>")))
    return rows.select("key", "decision", kept.alias("mapping"), best["total"].alias("best"), same["total"].alias("identity_cost"), second["total"].alias("second"))


def aggregate_sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def swap_safety(tracks: DataFrame, pairs: DataFrame, start: int, end: int) -> DataFrame:
    """pairs (a, b) with differing: the frames start..end that only one of them has, and safe: none is."""
    seen = tracks.where(F.col("frame").between(start, end)).select("tid", "frame").distinct()
    each = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("tid")).join(seen, "tid").groupBy("a", "b", "frame").agg(F.count("*").alias("n"))
    odd = each.where("n = 1").groupBy("a", "b").agg(F.count("*").alias("differing"))
    return pairs.join(odd, ["a", "b"], "left").select("a", "b", F.coalesce("differing", F.lit(0)).cast("long").alias("differing"), F.col("differing").isNull().alias("safe"))


def slots(tracks: DataFrame, group: str) -> DataFrame:
    """group, frame, tid, slot: in frame order every id takes the slot it had before if that is free, else the lowest free one. Order matters, so one group per video."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "tid"])
        had: dict[int, int] = {}
        active: dict[int, int] = {}
        out = []
        for _, now in pdf.groupby("frame", sort=True):
            here = now["tid"].tolist()
            active = {t: s for t, s in active.items() if t in set(here)}
            used = set(active.values())
            for t in [t for t in here if t not in active and had.get(t) is not None and had[t] not in used]:
                if had[t] not in used:
                    active[t] = had[t]
                    used.add(had[t])
            for t in here:
                if t not in active:
                    s = next(k for k in range(len(used) + 1) if k not in used)
                    active[t] = had[t] = s
                    used.add(s)
            out += [active[t] for t in here]
        return pdf[[group, "frame", "tid"]].assign(slot=np.array(out, np.int64))

    rows = tracks.select(F.col(group).cast("string").alias(group), "frame", "tid").distinct()
    return spread(rows, group).groupBy(group).applyInPandas(run, f"{group} string, frame bigint, tid bigint, slot bigint")
