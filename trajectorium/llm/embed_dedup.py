"""Near-duplicate embeddings by collision-counting projections.

Every vector, scaled to length one, is projected on random lines, and two
vectors collide on a line if the second lies in the window around the first. At
a cosine of `threshold`, projections differ by a normal variate of known spread,
so the chance of a collision is known. A pair is a candidate if it collides on
enough of `lines` lines; how many is chosen from the binomial distribution. Pairs that
pass are verified by cosine in double precision. Only vectors with equal labels
meet.

So as not to count for every pair, windows are searched in sorted tables. A
table joins several lines, cut at zero, into a cell, and sorts the vectors of
each cell along one more line; windows are then short runs of the sorted
vectors. Both the cell and the window can miss a pair, so there are as many
tables as the recall needs: vectors at the threshold's angle are on one side of
a random cut with a chance of 1 - angle / pi, whatever the vectors' distribution.
A cell takes as many cuts as leave about `cell` vectors in it, so the pairs of a
vector that are looked at don't grow with the table but for the number of tables,
a small power of its size. A pair counts where it first collides.

The same cut happens once before, between tasks: a label of more vectors than a
task holds (`task_bytes`) is dealt by cells into tasks, in several tables of
cells; one of fewer is one task. A cell that yet has more vectors, because they
are near copies, is dealt in parts, each pair of parts a task, so no task grows.
A task returns each vector's number of links and a spanning forest, not the
pairs. Each of the three chances (cells of tasks, tables, count) is at least
`recall` for a pair at the threshold, and nearer to 1 for closer ones.

Equal vectors of a label are one class from the start; rows find their class by
two 64-bit hashes of the vector.

A vector that is null, zero or holds null or non-finite components, or whose
label is null, links with nothing: 0 links, its own component, kept; so does a
row without a vec_id, whose component is null. A vector of another length than
another's doesn't link with it; long vectors only lower the number in a task.
Repeated rows are vectors of their own and link. Of equal candidates none comes
first: links are a set, and a component's id is its smallest vec_id. An empty
table gives an empty result; other columns, whatever their names, are left
alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import ragged
from .components import components
from .simhash import forest

THRESHOLD = 0.93
LINES = 48
#: Half the window of the count's lines and of the tables' sorted lines, in spreads of the difference of two projections at the threshold.
WINDOW = 1.6
TABLE_WINDOW = 2.0
RECALL = 0.999
#: Vectors that a cell of a table should hold.
CELL = 64
#: Bytes of vectors (as doubles) that a task should hold.
TASK_BYTES = 8 << 20
SEED = 20240229
#: Places on sorted lines are whole numbers of this share of 1.
GRID = 1 << 30
#: Lines that a pair's count starts with.
FIRST = 16
#: Pairs that are counted at once.
STRIP = 1 << 16


def needed(lines: int = LINES, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with a chance of `recall` at least."""
    p = math.erf(window / math.sqrt(2))
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > 1 - recall:
            return k
    return lines


def tables_for(cuts: int, threshold: float = THRESHOLD, recall: float = RECALL, window: float | None = None) -> int:
    """How many tables a pair at the threshold needs to meet in one of them with a chance of `recall`: in a cell of so many cuts and, where there is one, in a window."""
    p = (1 - math.acos(threshold) / math.pi) ** cuts * (math.erf(window / math.sqrt(2)) if window else 1)
    return 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))


def projections(unit: np.ndarray, use: int, lines: int) -> np.ndarray:
    """Of each row on random lines, the same for all rows of a length; use: 0 cells of tasks, 1 cells of tables, 2 their sorted lines, 3 the count's."""
    draw = np.random.default_rng([SEED, use, unit.shape[1]])
    return unit @ draw.standard_normal((lines, unit.shape[1])).T  # a row of draws for each line: more lines begin with the same ones


def cells(unit: np.ndarray, use: int, tables: int, cuts: int) -> np.ndarray:
    """The cell of each row in each table."""
    if not cuts:
        return np.zeros((len(unit), tables), np.int64)
    side = projections(unit, use, tables * cuts).reshape(len(unit), tables, cuts) > 0
    return side.astype(np.int64) @ (1 << np.arange(cuts, dtype=np.int64))


class Search:
    """The pairs of a task's vectors that collide in a table and on enough lines."""

    def __init__(self, unit: np.ndarray, threshold: float = THRESHOLD, lines: int = LINES, window: float = WINDOW, table_window: float = TABLE_WINDOW, recall: float = RECALL, cell: int = CELL):
        n = len(unit)
        spread = math.sqrt(max(0.0, 2 - 2 * threshold))
        cuts = max(0, math.ceil(math.log2(max(n, 1) / cell)))
        self.tables = tables_for(cuts, threshold, recall, table_window)
        self.cell = cells(unit, 1, self.tables, cuts)
        self.place = np.rint(projections(unit, 2, self.tables) * GRID).astype(np.int64)
        self.reach = math.ceil(table_window * spread * GRID) + 1
        counted = projections(unit, 3, lines).astype(np.float32)
        first = min(FIRST, lines)
        self.first, self.rest = np.ascontiguousarray(counted[:, :first]), np.ascontiguousarray(counted[:, first:])
        self.half = np.float32(window * spread + 1e-6)
        self.least_first, self.least = needed(first, window, 1 - (1 - recall) / 2), needed(lines, window, 1 - (1 - recall) / 2)
        #: Pairs found in windows, and those of them that the count passed.
        self.looked = self.passed = 0

    def _met(self, x: np.ndarray, y: np.ndarray, table: int) -> np.ndarray:
        """Which pairs collide in a table before this one."""
        met = np.zeros(len(x), bool)
        for t in range(table):
            met |= (self.cell[x, t] == self.cell[y, t]) & (np.abs(self.place[x, t] - self.place[y, t]) <= self.reach)
        return met

    def pairs(self, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates, each once; side: only pairs across."""
        n = len(self.cell)
        for t in range(self.tables):
            place = self.place[:, t]
            order = np.lexsort((place, self.cell[:, t]))
            cell = self.cell[order, t]
            number = np.cumsum(np.concatenate(([0], cell[1:] != cell[:-1])))
            at = number * (int(np.ptp(place)) + self.reach + 1) + place[order] - place.min()
            # a window reaches both ways; the half after the query finds each pair once
            after = np.searchsorted(at, at + self.reach, "right") - np.arange(n) - 1
            total = np.cumsum(after)
            s = 0
            while s < n:
                e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + STRIP, "right")))
                q = np.arange(s, e)
                x, y = order[np.repeat(q, after[s:e])], order[ragged(q + 1, after[s:e])]
                s = e
                if side is not None:
                    keep = side[x] != side[y]
                    x, y = x[keep], y[keep]
                self.looked += len(x)
                count = (np.abs(self.first[x] - self.first[y]) <= self.half).sum(1)
                keep = count >= self.least_first
                x, y, count = x[keep], y[keep], count[keep]
                if self.rest.shape[1]:
                    count += (np.abs(self.rest[x] - self.rest[y]) <= self.half).sum(1)
                    keep = count >= self.least
                    x, y = x[keep], y[keep]
                keep = ~self._met(x, y, t)
                x, y = x[keep], y[keep]
                if len(x):
                    self.passed += len(x)
                    yield x, y


def link_task(vectors: np.ndarray, copies: np.ndarray, side: np.ndarray | None = None, outer: np.ndarray | None = None, threshold: float = THRESHOLD, **options) -> tuple[np.ndarray, np.ndarray]:
    """The number of links to vectors of other classes that each class of a task gets, and each class's root. outer: the cells of each class in the tables of tasks before this one, where pairs with an equal one counted."""
    n = len(vectors)
    norm = np.sqrt((vectors * vectors).sum(1))
    gained = np.zeros(n, np.int64)
    root = np.arange(n)
    for x, y in Search(vectors / norm[:, None], threshold, **options).pairs(side):
        if outer is not None and outer.shape[1]:
            keep = (outer[x] != outer[y]).all(1)
            x, y = x[keep], y[keep]
        good = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norm[x] * norm[y]) >= threshold
        x, y = x[good], y[good]
        gained += np.bincount(x, weights=copies[y], minlength=n).astype(np.int64) + np.bincount(y, weights=copies[x], minlength=n).astype(np.int64)
        if len(x):
            own = np.flatnonzero(root != np.arange(n))
            root = forest(np.concatenate((x, own)), np.concatenate((y, root[own])), n)
    return gained, root


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _placed(classes: DataFrame, threshold: float, recall: float, with_vectors: bool) -> DataFrame:
    """classes (with cuts) in every table of tasks: label, size, tab, cell and, with vectors, rep, copies, v and met (the cells in the tables before)."""
    label, vector = classes.schema["label"].dataType.simpleString(), classes.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, cuts = b.column("size").to_numpy(), b.column("cuts").to_numpy()
            for kind in np.unique(np.stack((size, cuts), 1), axis=0).tolist() if len(size) else []:
                own = b.filter(pa.array((size == kind[0]) & (cuts == kind[1])))
                n, tables = own.num_rows, tables_for(kind[1], threshold, recall)
                vectors = _matrix(own.column("v"), n)
                cell = cells(vectors / np.sqrt((vectors * vectors).sum(1))[:, None], 0, tables, kind[1])
                for t in range(tables):
                    columns = [own.column("label"), own.column("size"), pa.array(np.full(n, t, np.int32)), pa.array(cell[:, t])]
                    if with_vectors:
                        columns += [own.column("rep"), own.column("copies"), own.column("v"), pa.array(list(cell[:, :t]), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["label", "size", "tab", "cell", "rep", "copies", "v", "met"][: len(columns)])

    return classes.mapInArrow(run, f"label {label}, size int, tab int, cell bigint" + f", rep bigint, copies bigint, v {vector}, met array<bigint>" * with_vectors)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, lines: int = LINES, window: float = WINDOW, recall: float = RECALL, cell: int = CELL, task_bytes: int = TASK_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    ship(spark)
    held = embeddings.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding").cast(held if held in ("array<float>", "array<double>") else "array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # equal up to the sign of zero
    rows = rows.withColumn("ok", usable).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + F.lit(0.0).cast(held[6:-1] if held == "array<float>" else "double"))))
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2")]
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.select("label", "rep", "copies", "v", F.size("v").alias("size"), *hashes), "classes")
    task = F.greatest(F.lit(2), F.floor(F.lit(task_bytes) / (8 * F.col("size"))))
    parts = classes.groupBy("label", "size").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / task))).cast("int").alias("cuts"))
    placed = classes.join(parts, ["label", "size"])
    # cells of over twice the vectors that a task should hold are few, or near copies
    crowded = _placed(placed, threshold, recall, False).groupBy("label", "size", "tab", "cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / task).cast("int"))
    crowded = materialize(crowded.where("parts > 2").drop("n"), "crowded")
    dealt = _placed(placed, threshold, recall, True).join(crowded, ["label", "size", "tab", "cell"], "left").fillna(1, ["parts"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    name = F.concat_ws(":", "label", "size", "tab", "cell", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select("rep", "copies", "v", "met", name.alias("task"), (F.col("own") > F.col("other")).alias("side"), (F.col("own") == F.col("other")).alias("same"))
    ordered = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = t.column("rep").to_numpy()
            v = _matrix(t.column("v").combine_chunks(), len(ids))
            side = None if t.column("same")[0].as_py() else t.column("side").to_numpy().astype(np.int8)
            met = t.column("met").combine_chunks()
            outer = met.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            gained, root = link_task(v, t.column("copies").to_numpy().astype(float), side, outer, threshold, lines=lines, window=window, recall=recall, cell=cell)
            some = np.flatnonzero((gained > 0) | (root != np.arange(len(ids))))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(gained[some]), pa.array(ids[root[some]])], names=["rep", "gained", "root"])

        for b in batches:
            task = b.column("task").to_pylist()
            cuts = [0, *(k for k in range(1, len(task)) if task[k] != task[k - 1]), len(task)] if task else []
            for s, e in zip(cuts, cuts[1:]):
                if held and task[s] != now:
                    yield from flush()
                now = task[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from flush()

    found = materialize(ordered.mapInArrow(run, "rep bigint, gained bigint, root bigint"), "links")
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    gained = found.groupBy("rep").agg(F.sum("gained").alias("gained"))
    # narrow rows from here on: a common vector's rows are many, its class is one, and Spark broadcasts the classes or splits the skewed rows
    result = classes.select("label", "h1", "h2", "rep", "copies").join(gained, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    result = result.select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("gained", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    narrow = rows.select("vec_id", F.when(F.col("ok"), F.col("label")).alias("label"), *hashes)
    return (
        narrow.join(materialize(result, "classes-found"), ["label", "h1", "h2"], "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
