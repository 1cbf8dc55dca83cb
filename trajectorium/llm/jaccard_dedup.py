"""Near-duplicates by the Jaccard similarity of word shingles.

Texts link whose sets of shingles of `words` words have a similarity of at
least SIMILARITY, and linked texts form components. Equal sets are one class
from the start. Candidates agree on all ROWS minimum hashes of one of BANDS
bands; each one's similarity is then counted from the two texts, so every link
is right. A pair of similarity 0.8 has no such band with probability
(1 - 0.8**4)**24, about 3 in a million, a more similar one less. Fingerprints
of 64 bits don't serve here: at 0.8 they differ in 10 bits on average and at
times in 20.

First each text meets one smaller row: the smallest that its SimHash fingerprint
reaches by pigeonhole blocks (`simhash`, whose links are checked here), or else
that with which it shares most bands of those that are the smallest of a bucket.
So a group of copies costs as many comparisons as it has texts. Then those pairs
of a bucket meet that are not in one component yet, each in the first bucket that
it shares, inside the task that has it. Texts that share a passage, and so
buckets, but no more are many, so these pairs are first compared by signatures of
BINS bytes: a pair goes on if its signatures agree in as many places as a pair of
SIMILARITY would but for a chance of a few in a million. What is left is counted
from both sets there, and the task hands on a forest of its links, so that tables
grow with the texts. A bucket of over CROWD rows or many hashes is dealt into
parts, each pair of parts for itself.

Null and empty texts, and texts without a word, have the empty set. Texts of
fewer words than a shingle are one shingle. Very long texts are compared whole.
Repeated rows are one class. An empty table has no copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, ship
from . import simhash
from .common import give_back, strings, units
from .components import components

WORDS = 5
#: Least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
ROWS = 4
BANDS = 24
SEED = 42
#: Bytes of a signature: of so many shares of all hashes, a byte of the smallest.
BINS = 512
#: How many standard deviations below the expected a pair's agreement may be.
SPREAD = 4.5
#: Rows of a bucket that are compared in one task.
CROWD = 4096
#: Hashes of such rows.
MOST = 1 << 21
_draw = np.random.default_rng(SEED)
_XOR = _draw.integers(0, 1 << 64, ROWS * BANDS, np.uint64)
_ODD = _draw.integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = WORDS) -> set[int]:
    w = text.encode().lower().split()  # both for ASCII only, as in simhash
    one = xxhash.xxh64_intdigest
    if len(w) < words:
        return {one(b" ".join(w), SEED)} if w else set()
    return {one(b" ".join(g), SEED) for g in zip(*(w[i:] for i in range(words)))}


def band_keys(sets: list[set[int]]) -> np.ndarray:
    """One row of BANDS keys for each set, none of them empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    h = np.fromiter((x for s in sets for x in s), np.uint64, int(sizes.sum()))
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64) * _MIX
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = (key ^ np.minimum.reduceat((h ^ _XOR[k]) * _ODD[k], starts)) * _MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def signatures(sets: list[set[int]]) -> np.ndarray:
    """One row of BINS bytes for each set; 0 where the set has no hash in that share."""
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.fromiter((x for s in sets for x in s), np.uint64, int(sizes.sum())) * _MIX
    out = np.zeros((len(sets), BINS), np.uint8)
    if len(h):
        h ^= h >> np.uint64(31)
        h *= _MIX
        place = np.repeat(np.arange(len(sets)), sizes) * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        order = np.lexsort((h, place))
        first = order[np.concatenate(([True], place[order[1:]] != place[order[:-1]]))]
        out.ravel()[place[first]] = (h[first] & np.uint64(0xFFFFFFFF)) % np.uint64(255) + np.uint64(1)
    return out


def plausible(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether signatures, row by row, agree as those of similar sets do; sizes: of both sets together.

    The smallest hashes of the shares that either set has are a draw without
    replacement from the sets' union, so the number that agrees is hypergeometric.
    """
    same = ((a == b) & (a > 0)).sum(-1)
    used = ((a | b) > 0).sum(-1)
    share = SIMILARITY[0] / SIMILARITY[1]
    union = sizes / (1 + share)
    rest = np.clip((union - used) / np.maximum(union - 1, 1), 0, 1)
    return same >= share * used - SPREAD * np.sqrt(share * (1 - share) * used * rest) - 1


def sketches(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """row, sum and n (of the set), keys (of its bands; none for the empty set), signature. rows: row, text."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches):
            sets = [shingles(t, words) for t in strings(b.column("text"))]
            full = [s for s in sets if s]
            keys = iter(band_keys(full).view(np.int64).tolist() if full else [])
            sums = np.array([sum(s) & 0xFFFFFFFFFFFFFFFF for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(sums), pa.array([len(s) for s in sets], pa.int64()), pa.array([next(keys) if s else [] for s in sets], pa.list_(pa.int64())), pa.array([x.tobytes() for x in signatures(sets)], pa.binary())],
                names=["row", "sum", "n", "keys", "signature"],
            )

    return rows.select("row", F.col("text").cast("string").alias("text")).mapInArrow(run, "row bigint, sum bigint, n bigint, keys array<bigint>, signature binary")


def similar(a: set[int], b: set[int]) -> bool:
    both = len(a & b)
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def verified(pairs: DataFrame, rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Those of the pairs a, b of rows whose texts are similar. A text moves once for each pair it is b of, and once for all that it is a of."""
    texts = rows.select("row", F.col("text").cast("string").alias("text"))
    both = pairs.join(texts.toDF("b", "other"), "b").join(texts.toDF("a", "text"), "a").select("a", "b", "text", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, set[int]] = (None, set())
        for b in units(batches):
            keep = []
            for a, t, o in zip(b.column("a").to_pylist(), b.column("text").to_pylist(), b.column("other").to_pylist()):
                if held[0] != a:
                    held = (a, shingles(t or "", words))
                keep.append(similar(held[1], shingles(o or "", words)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def compared(rep: np.ndarray, n: np.ndarray, part: np.ndarray, own: np.ndarray, across: np.ndarray, group: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plausible pairs of rows of one group, of different parts and of sizes that can be similar; across: only between different own. Rows come sorted by group."""
    a, b = [], []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    many = np.diff(np.append(starts, len(group)))

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        fit = (part[x] != part[y]) & (SIMILARITY[1] * np.minimum(n[x], n[y]) >= SIMILARITY[0] * np.maximum(n[x], n[y])) & (~across[x] | (own[x] != own[y]))
        x, y = x[fit], y[fit]
        for s in range(0, len(x), 1 << 15):
            p, q = x[s : s + (1 << 15)], y[s : s + (1 << 15)]
            good = plausible(signature[p], signature[q], n[p] + n[q])
            a.append(np.minimum(rep[p[good]], rep[q[good]]))
            b.append(np.maximum(rep[p[good]], rep[q[good]]))

    size = np.repeat(many, many)
    for shift in range(1, min(32, int(many.max(initial=0)))):  # groups of a few rows, all at once
        x = np.flatnonzero((size[:-shift] > shift) & (size[:-shift] <= 32) & (group[:-shift] == group[shift:]))
        keep(x, x + shift)
    for s, e in zip(starts[many > 32].tolist(), (starts + many)[many > 32].tolist()):
        for x in range(s, e - 1):
            keep(np.full(e - 1 - x, x), np.arange(x + 1, e))
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def linked(rep: np.ndarray, n: np.ndarray, part: np.ndarray, own: np.ndarray, across: np.ndarray, group: np.ndarray, signature: np.ndarray, key: np.ndarray, keys: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows of one group, of different parts, that share no bucket before this one. The sets are compared; otherwise as compared()."""
    a, b = [], []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(group)]):
        at = np.unique(part[s:e], return_inverse=True)[1]
        for x in range(s, e - 1):
            y = np.arange(x + 1, e)
            y = y[(at[y - s] != at[x - s]) & (SIMILARITY[1] * np.minimum(n[x], n[y]) >= SIMILARITY[0] * np.maximum(n[x], n[y])) & (~across[x] | (own[x] != own[y]))]
            if len(y):
                y = y[keys[x][(keys[x] == keys[y]).argmax(1)] == key[x]]
            for k in range(0, len(y), 1024):
                some = y[k : k + 1024]
                for z in some[plausible(signature[np.full(len(some), x)], signature[some], n[x] + n[some])].tolist():
                    if at[z - s] == at[x - s]:
                        continue
                    both = len(np.intersect1d(hashes[x], hashes[z], assume_unique=True))
                    if SIMILARITY[1] * both >= SIMILARITY[0] * (n[x] + n[z] - both):
                        a.append(min(rep[x], rep[z]))
                        b.append(max(rep[x], rep[z]))
                        at[at == at[z - s]] = at[x - s]
    return np.array(a, np.int64), np.array(b, np.int64)


def close(rest: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: the plausible pairs of each bucket's rows of different parts. rest: key, rep, n, part, signature; with keys (all of the row's) and hashes (its set's, as bytes), a forest of the links between them instead."""
    exact = [c for c in ("keys", "hashes") if c in rest.columns]
    share = F.greatest(F.count("*") / crowd, F.sum("n") / MOST if exact else F.lit(0.0))
    crowds = materialize(rest.groupBy("key").agg(share.alias("share")).where(F.col("share") > 1), "crowds")
    pieces = F.ceil(F.col("share") * 2).cast("int")
    dealt = rest.join(crowds, "key", "left").withColumn("pieces", F.when(F.col("share").isNull(), 1).otherwise(pieces)).withColumn("own", F.pmod(F.xxhash64("rep"), "pieces").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "part", "signature", *exact)
    ordered = dealt.repartition(int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(upto: int | None = None) -> Iterator[pa.RecordBatch]:
            """Compare the held rows, but for those from upto on."""
            t = pa.Table.from_batches(held)
            held.clear()
            if upto is not None:
                held.extend(t.slice(upto).to_batches())
                t = t.slice(0, upto)
            if t.num_rows:
                number = lambda c: t.column(c).to_numpy()
                new = reduce(np.logical_or, (np.diff(number(c)) != 0 for c in ("key", "i", "j")))
                signature = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(-1, BINS)
                given = (number("rep"), number("n"), number("part"), number("own"), number("i") != number("j"), np.concatenate(([0], np.cumsum(new))), signature)
                if exact:
                    a, b = linked(*given, number("key"), np.array(t.column("keys").to_pylist(), np.int64), [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()])
                else:
                    a, b = compared(*given)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows = sum(x.num_rows for x in held)
            if rows >= 4096 or sum(x.nbytes for x in held) >= 8 * MOST:  # all but the last group, which may go on
                ends = [x.column(c).to_numpy() for x in held for c in ("key", "i", "j")]
                names = [np.concatenate(ends[k::3]) for k in range(3)]
                last = np.flatnonzero(reduce(np.logical_or, (x != x[-1] for x in names)))
                if len(last):
                    yield from flush(int(last[-1]) + 1)
        if held:
            yield from flush()
        give_back()

    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def hashed(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """rep, hashes: each text's set in order, as bytes. rows: rep, text."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches):
            sets = [np.sort(np.fromiter(shingles(t, words), np.uint64)).tobytes() for t in strings(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(sets, pa.binary())], names=["rep", "hashes"])

    return rows.select("rep", F.col("text").cast("string").alias("text")).mapInArrow(run, "rep bigint, hashes binary")


def _sized(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(a, b) * SIMILARITY[1] >= F.greatest(a, b) * SIMILARITY[0]


def copies(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """row of every row that isn't the smallest of its component. rows: row (distinct longs), text."""
    found = materialize(sketches(rows, words), "sketches")
    classes = materialize(found.groupBy("sum", "n").agg(F.min("row").alias("rep"), F.any_value("keys").alias("keys")), "classes")
    keyed = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("many")).where("many > 1").select("key", "head")
    buckets = materialize(keyed.join(shared, "key"), "buckets")
    met = buckets.where((F.col("rep") != F.col("head.rep")) & _sized(F.col("n"), F.col("head.n"))).groupBy(F.col("head.rep").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("bands"))
    met = met.groupBy("b").agg(F.min_by("a", F.struct(-F.col("bands"), "a")).alias("a"))
    reached = simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), words).where("component_id < doc_id").select(F.col("doc_id").alias("b"), F.col("component_id").alias("near"))
    reached = reached.join(classes.select(F.col("rep").alias("b")), "b", "left_semi")
    first = materialize(met.join(reached, "b", "full").select(F.coalesce("near", "a").alias("a"), "b"), "pairs")
    links = materialize(verified(first, rows, words), "links")
    part = materialize(components(links), "parts")
    now = materialize(buckets.join(part.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("part")), "now")
    open_ = now.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    rest = materialize(now.join(materialize(open_, "open"), "key"), "rest")
    asked = materialize(rest.select("rep").distinct(), "asked")
    sets = materialize(hashed(rows.withColumnRenamed("row", "rep").join(asked, "rep", "left_semi"), words), "sets")
    held = found.select(F.col("row").alias("rep"), "signature", "keys").join(sets, "rep")
    more = materialize(close(rest.join(held, "rep")), "links")
    whole = components(links.unionByName(more))
    of = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("sum", "n", F.coalesce("component", "rep").alias("component"))
    gone = materialize(found.select("row", "sum", "n").join(materialize(of, "components"), ["sum", "n"]).where("row <> component").select("row"), "gone")
    discard(found, classes, buckets, first, links, part, now, rest, asked, sets, more)
    return gone
