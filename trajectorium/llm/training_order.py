"""Training-order materialisation: token sequences in a keyed global order, in fixed-stride shards.

Texts become token ids, cut into sequences of `seq_len`; the last of a document
is filled up with the end id. Every sequence has a dense index: its rank by
doc_id, then by two hashes of the text, then by its place in the document. So the
order belongs to the rows, and not to files, splits or tasks: rows of equal id and
text give equal sequences, whichever comes first. A first pass counts each row's
sequences; the counts, a narrow table, are sorted and summed up over ranges, and
each row's first index is written to side files by the row's place in the input
(its file and number), 16 bytes a row. A second pass over the input emits ids
and looks its rows' indices up there, so that no copy of texts or ids is held
besides the ids that are dealt out. Input that isn't read from Parquet files as it
stands is written to such first. What goes to the driver is a number for each
range. A row that yet has another number of sequences than counted fails. A keyed
Feistel network over the smallest power of two that holds all indices, walked along
its cycle until the value is an index again, permutes them into slots; a walk that
doesn't end fails.
Slots are dealt by range, one shard to a task; a task writes its shard as one
file of records of seq_len * 2 bytes (little-endian unsigned 16-bit ids), so
that slot s is record s mod shard_records of shard s div shard_records, and a
reader resumes anywhere by seeking. A shard is written under a name of its
attempt and then takes the place of what is there; a repeated attempt or action
writes the same bytes.

Null and empty texts give one sequence of end ids with n_tokens 0. Texts of any
length are read whole and may fill many shards. Null ids come first. Repeated rows
give a sequence each; their ties decide nothing, as their records are alike. An
empty table gives no shard and no rows. Other columns are left alone whatever their names.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, fresh_path, materialize, ship
from .bpe import encoder
from .common import units

SEQ_LEN = 512
SHARD_RECORDS = 16384
END = 50256
ROUNDS = 8
#: Each step of a walk ends it with a chance of a half at least; one that takes more steps than this fails.
WALK = 96
#: Bytes of text that a worker tokenises at once.
UNIT = 2 << 20
#: Rows of an input file whose indices are one side file.
CHUNK = 1 << 19


def permuted(index: Column, n: int, key: str) -> Column:
    """A permutation of 0..n-1, chosen by the key."""
    bits = max(2, int(n - 1).bit_length())
    low = bits // 2
    low_mask, high_mask = (1 << low) - 1, (1 << (bits - low)) - 1
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:7], "little") for r in range(ROUNDS)]

    def network(x: Column) -> Column:
        rounds = F.array(*[F.struct(F.lit(r % 2).alias("odd"), F.lit(k).alias("key")) for r, k in enumerate(keys)])
        begin = F.struct(F.shiftright(x, low).alias("high"), x.bitwiseAND(F.lit(low_mask).cast("long")).alias("low"))

        def step(s: Column, r: Column) -> Column:
            high = F.when(r["odd"] == 1, s["high"]).otherwise(s["high"].bitwiseXOR(F.xxhash64(s["low"], r["key"]).bitwiseAND(F.lit(high_mask).cast("long"))))
            rest = F.when(r["odd"] == 0, s["low"]).otherwise(s["low"].bitwiseXOR(F.xxhash64(s["high"], r["key"]).bitwiseAND(F.lit(low_mask).cast("long"))))
            return F.struct(high.alias("high"), rest.alias("low"))

        return F.aggregate(rounds, begin, step, lambda s: F.shiftleft(s["high"], low).bitwiseOR(s["low"]))

    first = network(index.cast("long"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.transform(F.array(walked), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a walk along the permutation's cycle didn't end")).cast("bigint")))[0]


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, file and row: where each row stands in Parquet files, to which docs is written if it isn't read from such."""
    columns = [F.col("doc_id"), F.col("text").cast("string").alias("text")]
    try:
        return docs.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        held = materialize(docs.select(*columns), "documents")
        return held.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def indexed(rows: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN) -> tuple[DataFrame, int]:
    """file, row, first (the index of the row's first sequence) and n (its sequences) of placed rows, and how many sequences there are."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches, most=UNIT):
            n = np.maximum(1, -(-encoder(tokenizer).counts(b.column("text")) // seq_len))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "h1", "h2", "file", "row")), pa.array(n, pa.int64())], names=["doc_id", "h1", "h2", "file", "row", "n"])

    hashed = rows.select("doc_id", "text", F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"), "file", "row")
    counts = materialize(hashed.mapInArrow(count, f"doc_id {kind}, h1 bigint, h2 bigint, file string, row bigint, n bigint"), "counts")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.column("n").to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), b.column("file"), b.column("row"), pa.array(ends - n), b.column("n")], names=["part", "file", "row", "before", "n"])
            total = int(ends[-1]) if len(n) else total

    # place in the files comes last: it only parts rows that are alike, so that many of one key go to several ranges
    order = ["doc_id", "h1", "h2", "file", "row"]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = counts.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(add, "part int, file string, row bigint, before bigint, n bigint")
    summed = materialize(summed, "ranks")
    discard(counts)
    begins, total = [], 0
    for r in summed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each range
        begins.append((r["part"], total))
        total += r["n"]
    begin = rows.sparkSession.createDataFrame(begins, "part int, begin bigint")
    return summed.join(F.broadcast(begin), "part").select("file", "row", (F.col("begin") + F.col("before")).alias("first"), "n"), total


def _side_file(folder: str, file: str, chunk: int) -> str:
    return f"{folder}/{hashlib.sha256(file.encode()).hexdigest()}-{chunk}"


def write_side_files(index: DataFrame, path: str) -> None:
    """first and n of each row, at its place: CHUNK rows of an input file to a side file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        key, held = None, []
        for b in batches:
            for file, chunk, row, first, n in zip(*(b.column(c).to_pylist() for c in ("file", "chunk", "row", "first", "n"))):
                if (file, chunk) == key and row == held[-3]:
                    raise RuntimeError("a row of the input file occurs twice: write the documents as a table first")
                if (file, chunk) != key:
                    if held:
                        _replace(system, _side_file(folder, *key), np.array(held, "<i8").tobytes())
                    key, held = (file, chunk), []
                held += [row, first, n]
        if held:
            _replace(system, _side_file(folder, *key), np.array(held, "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([True])], names=["done"])

    keyed = index.withColumn("chunk", F.floor(F.col("row") / CHUNK))
    keyed.repartition("file", "chunk").sortWithinPartitions("file", "chunk", "row").mapInArrow(run, "done boolean").count()


def _replace(system, name: str, data: bytes) -> None:
    """The file of that name has these bytes, also if a task that did so before was taken for lost."""
    own = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    _rename(system, own, name)


def _rename(system, own: str, name: str) -> None:
    """Some file systems don't rename onto a file: what is there, of equal bytes, goes first."""
    if system.get_file_info(name).type == fs.FileType.File:
        with contextlib.suppress(FileNotFoundError):
            system.delete_file(name)
    system.move(own, name)


class Indices:
    """Looks up first and n of rows; the side file used last is held."""

    def __init__(self, path: str):
        self.system, self.folder = fs.FileSystem.from_uri(path)
        self.key, self.table = None, None

    def of(self, files: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, n = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        chunks = rows // CHUNK
        names = np.array(files, object)
        turns = np.flatnonzero(np.r_[True, (chunks[1:] != chunks[:-1]) | (names[1:] != names[:-1])]) if len(rows) else []
        for s, e in zip(turns, [*turns[1:], len(rows)]):
            key = (names[s], int(chunks[s]))
            if key != self.key:
                with self.system.open_input_file(_side_file(self.folder, *key)) as f:
                    self.key, self.table = key, np.frombuffer(f.read(), "<i8").reshape(-1, 3)
            at = np.minimum(np.searchsorted(self.table[:, 0], rows[s:e]), len(self.table) - 1)
            if (self.table[at, 0] != rows[s:e]).any():
                raise RuntimeError("the input changed between the passes: a row has no index")
            first[s:e], n[s:e] = self.table[at, 1], self.table[at, 2]
        return first, n


def sequences(rows: DataFrame, tokenizer: str, seq_len: int, side: str) -> DataFrame:
    """doc_id, piece, n_tokens, ids (binary, without filling) and index of placed rows."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indices = Indices(side)
        for b in units(batches, most=UNIT):
            ids, counts = encoder(tokenizer).encode(b.column("text"))
            ids = ids.astype("<u2")
            many = np.maximum(1, -(-counts // seq_len))
            first, counted = indices.of(b.column("file").to_pylist(), b.column("row").to_numpy())
            if (counted != many).any():
                raise RuntimeError("the input changed between the passes: a row has another number of sequences")
            row = np.repeat(np.arange(len(counts)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = np.repeat(np.cumsum(counts) - counts, many) + piece * seq_len
            n = np.minimum(counts[row] - piece * seq_len, seq_len)
            data = memoryview(ids.tobytes())
            parts = [bytes(data[2 * s : 2 * (s + k)]) for s, k in zip(start.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(n, pa.int32()), pa.array(parts, pa.binary()), pa.array(first[row] + piece)],
                names=["doc_id", "piece", "n_tokens", "ids", "index"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, n_tokens int, ids binary, index bigint")


def write_shards(found: DataFrame, total: int, path: str, key: str, seq_len: int = SEQ_LEN, shard_records: int = SHARD_RECORDS, end_id: int = END) -> DataFrame:
    """Writes found (see sequences), `total` rows, to shards under path, a URI that executors share; one row per sequence: doc_id, piece, slot, shard, record, n_tokens, record_crc32 (of the record as read back)."""
    spark = found.sparkSession
    kind = found.schema["doc_id"].dataType.simpleString()
    if not total:
        return spark.createDataFrame([], f"doc_id {kind}, piece int, slot bigint, shard bigint, record bigint, n_tokens int, record_crc32 bigint")
    slotted = found.select("doc_id", "piece", "n_tokens", "ids", permuted(F.col("index"), total, key).alias("slot"))
    slotted = slotted.withColumn("shard", F.floor(F.col("slot") / shard_records).cast("int"))
    shards = -(-total // shard_records)
    ordered = slotted.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    stride = 2 * seq_len
    fill = np.full(seq_len, end_id, "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        out, shard, temporary = None, None, None

        def close():
            out.close()
            _rename(system, temporary, f"{folder}/shard-{shard:08d}.bin")

        held = []
        for b in batches:
            own = b.column("shard").to_pylist()
            for k, x in enumerate(b.column("ids").to_pylist()):
                if own[k] != shard:
                    if out:
                        close()
                    shard, temporary = own[k], f"{folder}/.{own[k]:08d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                out.write(x + fill[len(x) :])
            held.append(b.drop_columns(["ids"]))
        if out:
            close()
        for b in held:
            slots = b.column("slot").to_numpy()
            crcs = [zlib.crc32(x) for x in _records(system, folder, slots, stride, shard_records)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("piece"), b.column("slot"), b.column("shard").cast(pa.int64()), pa.array(slots % shard_records), b.column("n_tokens"), pa.array(crcs, pa.int64())],
                names=["doc_id", "piece", "slot", "shard", "record", "n_tokens", "record_crc32"],
            )

    return ordered.mapInArrow(run, f"doc_id {kind}, piece int, slot bigint, shard bigint, record bigint, n_tokens int, record_crc32 bigint")


def _records(system, folder: str, slots: np.ndarray, stride: int, shard_records: int) -> Iterator[bytes]:
    """The records of increasing slots."""
    at, file = None, None
    for s in slots.tolist():
        if s // shard_records != at:
            at = s // shard_records
            file = system.open_input_file(f"{folder}/shard-{at:08d}.bin")
        yield file.read_at(stride, s % shard_records * stride)


def read_slots(path: str, start: int, n: int, seq_len: int = SEQ_LEN, shard_records: int = SHARD_RECORDS) -> np.ndarray:
    """Sequences start..start+n-1 in training order, as an array of n rows."""
    system, folder = fs.FileSystem.from_uri(path)
    found = b"".join(_records(system, folder, np.arange(start, start + n), 2 * seq_len, shard_records))
    return np.frombuffer(found, "<u2").reshape(n, seq_len)


def training_order(docs: DataFrame, tokenizer: str, key: str, path: str | None = None, seq_len: int = SEQ_LEN, shard_records: int = SHARD_RECORDS, end_id: int = END) -> DataFrame:
    """Writes the shards and returns their manifest, one row per sequence."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = placed(docs)
    index, total = indexed(rows, tokenizer, seq_len)
    side = fresh_path(spark, "indices")
    write_side_files(index, side)
    return write_shards(sequences(rows, tokenizer, seq_len, side), total, path or fresh_path(spark, "shards"), key, seq_len, shard_records, end_id)
