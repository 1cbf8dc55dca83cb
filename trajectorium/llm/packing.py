"""Best-two-fit packing of documents into sequences of bounded length.

Documents become token ids and an end id; longer ones are cut into full pieces
and a rest. Which piece goes where depends on lengths alone, of which there are
at most `capacity` different ones, so packing works on the histogram of
lengths, whatever the number of documents: the driver holds `capacity` counts
and a list of bin patterns whose number is bounded by them too. Each bin is
filled greedily, longest first; then its smallest piece gives way to the two
unpacked pieces that fit the widened gap most tightly. A pattern repeats as
often as the counts allow. Pieces take their places by rank among the pieces of
their length, and ranks come from counts of (length, salt), so that a length
which a third of all pieces share is spread over all tasks; salts come from a
number of each written piece, so rows of one document id or none are spread too.

Null texts are empty: one piece, the end id alone. Very long texts are many
pieces. A null doc_id is carried along. An empty table gives an empty result.
Repeated rows are packed each for itself. Of two pairs of pieces that fit alike,
the one with the longer piece is taken; pieces of one length are alike and take
places by their numbers. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship
from .bpe import encoder
from .common import batch, units

CAPACITY = 2048
#: Salts of a length's pieces; a task ranks the pieces of one (length, salt).
SALTS = 4096

PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches):
            ids, counts = encoder(tokenizer).encode(b.column("text"))
            row, piece, start, length, crc, held = [], [], [], [], [], []
            at = 0
            end = np.array([end_id], "<u4")
            ids = ids.astype("<u4")
            for k, n in enumerate(counts.tolist()):
                own = np.concatenate((ids[at : at + n], end))
                at += n
                for p, s in enumerate(range(0, n + 1, capacity)):
                    part = own[s : s + capacity].tobytes()
                    row.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part) >> 2)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        held.append(part)
            out = batch(PIECES, piece=piece, start=start, length=length, ids_crc32=crc)
            columns, names = [b.column("doc_id").take(pa.array(row, pa.int64())), *out.columns], ["doc_id", *PIECES.names]
            if with_ids:
                columns.append(pa.array(held, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, how many in each bin), ...]) patterns that use every piece once."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    patterns = []
    longest = capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return patterns
        bin_: list[int] = []  # longest first
        gap = capacity
        used: dict[int, int] = {}

        def free(n: int, used=used) -> int:
            return int(left[n]) - used.get(n, 0)

        size = longest
        while gap and size:
            size = min(size, gap)
            while size and free(size) <= 0:
                size = _below(left, size)
            if not size:
                break
            take = min(free(size), gap // size)
            bin_ += [size] * take
            used[size] = used.get(size, 0) + take
            gap -= size * take
        if gap and len(bin_) > 1:  # two that fit the gap left by the smallest one better than it
            last = bin_[-1]
            room = gap + last
            used[last] -= 1
            best = (last, 0, 0)
            a = room
            while (a := _below(left, a + 1) if free(min(a, capacity)) <= 0 else a) and 2 * a > best[0]:
                if free(a) > 0:
                    b = min(a, room - a)
                    while b and (free(b) - (a == b)) <= 0:
                        b = _below(left, b)
                    if b and a + b > best[0]:
                        best = (a + b, a, b)
                        if a + b == room:
                            break
                a -= 1
            if best[1]:
                bin_[-1:] = best[1:]
                for x in best[1:]:
                    used[x] = used.get(x, 0) + 1
            else:
                used[last] += 1
        need = {n: k for n, k in used.items() if k}
        times = min(int(left[n]) // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= times * k
        patterns.append((times, sorted(need.items(), reverse=True)))


def _below(left: np.ndarray, n: int) -> int:
    """The largest length under n that has pieces left; 0 if none."""
    found = np.flatnonzero(left[:n])
    return int(found[-1]) if len(found) else 0


def pack(found: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """found with sequence_id and offset, over a numbered copy of found in the shared folder."""
    spark = found.sparkSession
    numbered = materialize(found.withColumn("_number", F.monotonically_increasing_id()), "pieces")
    salted = numbered.withColumn("_salt", F.pmod(F.xxhash64("_number"), F.lit(SALTS)))
    groups = materialize(salted.groupBy(F.col(length_col).alias("_n"), "_salt").agg(F.count("*").alias("_c")), "packing-counts")
    counts = {r["_n"]: r["c"] for r in groups.groupBy("_n").agg(F.sum("_c").alias("c")).collect()}  # at most `capacity` rows
    segments, first = [], 0
    ranks: dict[int, int] = dict.fromkeys(counts, 0)
    for times, parts in best_two_fit(counts, capacity):
        offset = 0
        for n, k in parts:
            segments.append((n, ranks[n], ranks[n] + times * k, first, k, offset))
            ranks[n] += times * k
            offset += n * k
        first += times
    places = spark.createDataFrame(segments, "_n bigint, _from bigint, _to bigint, _bin bigint, _k bigint, _offset bigint")
    places = places.groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_bin", "_k", "_offset"))).alias("_places"))
    before = groups.withColumn("_before", F.sum("_c").over(Window.partitionBy("_n").orderBy("_salt")) - F.col("_c")).drop("_c")
    rank = Window.partitionBy("_n", "_salt").orderBy("_number")
    ranked = (
        salted.withColumn("_n", F.col(length_col))
        .withColumn("_r", F.row_number().over(rank) - 1)
        .join(before, ["_n", "_salt"])
        .withColumn("_r", F.col("_r") + F.col("_before"))
        .join(F.broadcast(places), "_n")  # at most `capacity` rows, with all patterns once
        .withColumn("_p", F.element_at(F.filter("_places", lambda p: p["_from"] <= F.col("_r")), -1))
    )
    at = F.col("_r") - F.col("_p._from")
    return ranked.select(
        *found.columns,
        (F.col("_p._bin") + F.floor(at / F.col("_p._k"))).cast("long").alias("sequence_id"),
        (F.col("_p._offset") + F.pmod(at, F.col("_p._k")) * F.col("_n")).cast("long").alias("offset"),
    )


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)
