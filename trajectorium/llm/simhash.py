"""SimHash near-duplicates by pigeonhole blocks.

A document's 64-bit fingerprint has the bits that more than half of its word
shingles' hashes have. Fingerprints within `distance` bits link, and linked
documents form components. Equal fingerprints are one class from the start. The
fingerprint is cut into `blocks` blocks; two that differ in at most `distance`
bits agree on blocks - distance of them at least, so classes meet under a key
for each such choice of blocks, and the classes of a key are compared with each
other by Hamming distance. A task emits a spanning forest of what it links, not
all pairs. A key that more than `crowd` classes share is cut into parts, and
its pairs of parts are dealt out as tasks of their own, so none is dropped.

Null and empty texts, and texts without a word, have fingerprint zero and link
like any other. Texts of fewer words than a shingle are one shingle. A row with
a null doc_id takes part; a component's id is its smallest doc_id, null if it
has none. Repeated rows repeat their result; an empty table gives an empty one;
other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import strings, units
from .components import components

WORDS = 3
DISTANCE = 3
BLOCKS = 5
CROWD = 8192
SEED = 42
_FOUR = np.uint64(0x0001000100010001)
#: Hashes summed at once: a sum of so many fits 16 bits.
_RUN = 65535


def bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each run of hashes have each bit: one row of 64 per run."""
    out = np.zeros((len(counts), 64), np.int64)
    runs, owner, k = [], [], 0
    for i, n in enumerate(counts.tolist()):
        for s in range(0, n, _RUN):
            runs.append(k + s)
            owner.append(i)
        k += n
    if not runs:
        return out
    for shift in range(16):  # four counters of 16 bits in each word
        four = np.add.reduceat((hashes >> np.uint64(shift)) & _FOUR, runs)
        for part in range(4):
            np.add.at(out[:, shift + 16 * part], owner, ((four >> np.uint64(16 * part)) & np.uint64(0xFFFF)).astype(np.int64))
    return out


def fingerprints_of(texts: list[str], words: int = WORDS) -> np.ndarray:
    hashed: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    one = xxhash.xxh64_intdigest
    for k, t in enumerate(texts):
        w = t.encode().lower().split()  # both for ASCII only
        if len(w) >= words:
            before = len(hashed)
            hashed += [one(b" ".join(g), SEED) for g in zip(*(w[i:] for i in range(words)))]
            counts[k] = len(hashed) - before
        elif w:
            hashed.append(one(b" ".join(w), SEED))
            counts[k] = 1
    bits = bit_counts(np.array(hashed, np.uint64), counts) * 2 > counts[:, None]
    return np.packbits(bits[:, ::-1], axis=1).view(">u8").astype(np.uint64).ravel() if len(texts) else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints_of(strings(b.column("text")), words).view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches by the links."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def _close(fp: np.ndarray, side: np.ndarray | None, distance: int) -> np.ndarray:
    """The root of each fingerprint of one key; side: compare only across."""
    n = len(fp)
    left, right = [], []
    step = max(1, (1 << 22) // n)
    for s in range(0, n, step):
        near = np.bitwise_count(fp[s : s + step, None] ^ fp[None, :]) <= distance
        if side is not None:
            near &= side[s : s + step, None] != side[None, :]
        a, b = np.nonzero(near)
        keep = a + s < b
        a, b = a[keep] + s, b[keep]
        if len(a):  # no more than n links are kept of each strip
            root = forest(a, b, n)
            own = np.flatnonzero(root != np.arange(n))
            left.append(own)
            right.append(root[own])
    if not left:
        return np.arange(n)
    return forest(np.concatenate(left), np.concatenate(right), n)


def links(classes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """classes: fp (distinct), rep. Returns links a, b of reps that span the components."""
    spark = classes.sparkSession
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    at = np.cumsum([0, *width[:-1]]).tolist()
    masks = [((1 << w) - 1) << s for w, s in zip(width, at)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = [F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[j] for j in c)))).alias("key")) for i, c in enumerate(combinations(range(blocks), blocks - distance))]
    keyed = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "k.choice", "k.key")
    crowds = materialize(keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "crowds")
    part = F.lit(0).cast("int")
    rows = keyed.withColumn("i", part).withColumn("j", part).withColumn("own", part)
    if not crowds.isEmpty():
        rest = keyed.join(crowds, ["choice", "key"], "left_anti")
        parts = F.ceil(F.col("n") * 2 / crowd).cast("int")
        dealt = keyed.join(crowds, ["choice", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = dealt.select("fp", "rep", "choice", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
        rows = rest.withColumn("i", part).withColumn("j", part).withColumn("own", part).unionByName(dealt)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(tasks, "choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def linked(cols: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
            fp, rep, new, own, i, j = cols
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(fp))
            many = ends - starts
            a, b = [], []
            few = many[np.cumsum(new) - 1]
            for shift in range(1, 33):  # keys of a few rows, all at once
                if not (small := (few > shift) & (few <= 32)).any():
                    break
                x = np.flatnonzero(small[:-shift]) if shift < len(fp) else np.zeros(0, np.int64)
                group = np.cumsum(new) - 1
                x = x[group[x] == group[x + shift]]
                x = x[(np.bitwise_count(fp[x] ^ fp[x + shift]) <= distance) & ((i[x] == j[x]) | (own[x] != own[x + shift]))]
                a.append(rep[x])
                b.append(rep[x + shift])
            for s, e in zip(starts[many > 32].tolist(), ends[many > 32].tolist()):
                root = _close(fp[s:e], own[s:e] if i[s] != j[s] else None, distance)
                x = np.flatnonzero(root != np.arange(e - s))
                a.append(rep[s:e][x])
                b.append(rep[s:e][root[x]])
            return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])

        def flush(cut: int | None) -> Iterator[pa.RecordBatch]:
            cols = tuple(np.concatenate(x) for x in zip(*held))
            held.clear()
            if cut is not None:
                held.append(tuple(x[cut:] for x in cols))
                cols = tuple(x[:cut] for x in cols)
            if len(cols[0]):
                a, b = linked(cols)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        before = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("choice", "key", "i", "j")])
            new = np.ones(b.num_rows, bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
            new[0] = before is None or (key[:, 0] != before).any()
            before = key[:, -1]
            held.append((b.column("fp").to_numpy().view(np.uint64), b.column("rep").to_numpy(), new, b.column("own").to_numpy(), key[2], key[3]))
            if new.any() and sum(len(h[0]) for h in held) >= 4 * 8192:
                last = sum(len(h[0]) for h in held[:-1]) + int(np.flatnonzero(new)[-1])
                yield from flush(last)
        if held:
            yield from flush(None)

    return sorted_.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = materialize(fingerprints(docs, words), "fingerprints")
    classes = found.groupBy("fp").agg(F.min("doc_id").cast("long").alias("least"))
    # a class without a doc_id goes by a negative number of its own; a component of such ones only has none
    classes = materialize(classes.select("fp", F.coalesce("least", -F.lit(1) - F.abs(F.xxhash64("fp"))).alias("rep"), F.col("least")), "classes")
    if classes.where("least IS NULL OR least < 0").isEmpty():
        joined = components(links(classes.select("fp", "rep"), distance, blocks, crowd))
        of = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    else:  # ids that aren't such numbers: components by fingerprint, then their smallest id
        by_fp = classes.select("fp", F.col("fp").alias("rep"), "least")
        joined = components(links(by_fp.select("fp", "rep"), distance, blocks, crowd))
        with_root = by_fp.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("component", "rep"))
        least = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
        of = with_root.join(least, "root").select("fp", "component_id")
    # a crowded fingerprint's rows are many, its class is one: between two tables, Spark broadcasts the classes or splits the skewed rows
    return found.join(materialize(of, "components"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
