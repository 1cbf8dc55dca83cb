"""BPE encoding and decoding by dynamic programming over prefixes.

Encoding stores, for every prefix of a pre-token, the unique token that can end
it: automaton matches propose tokens, pair-compatibility tests reject those
that merging would not leave there, and following the stored tokens back gives
the exact ids. Decoding joins the tokens' bytes.

Null texts are empty, empty texts have no ids, texts are taken whole whatever
their length; rows are independent, so repeated rows repeat their result and an
empty table gives an empty one. Other columns of the input are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .bpe import encoder, merges
from .common import batch, ragged, units


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens, concatenated, and their starts and lengths by id."""
    m = merges(path)
    coder = encoder(path, "prefix").engine
    words = coder.bytes_of
    lengths = np.array([len(w) for w in words], np.int64)
    assert len(words) == m.size
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode_ids(path: str, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The text of each run of ids; bytes that aren't UTF-8 become U+FFFD."""
    flat, starts, lengths = token_bytes(path)
    of = lengths[ids]
    data = flat[ragged(starts[ids], of)].tobytes()
    at = np.concatenate(([0], np.cumsum(of)))
    ends = np.cumsum(counts)
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[ends - counts].tolist(), at[ends].tolist())]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens long, ids binary (little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches):
            ids, counts = encoder(tokenizer, "prefix").encode(b.column("text"))
            data, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(counts, pa.int64()), pa.array([data[e - 4 * n : e] for e, n in zip(ends, counts.tolist())], pa.binary())],
                names=["id", "n_tokens", "ids"],
            )

    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text string: the inverse of encode()."""
    ship(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches, "ids"):
            parts = [np.frombuffer(x or b"", "<u4") for x in b.column("ids").to_pylist()]
            ids = np.concatenate([np.zeros(0, "<u4"), *parts]).astype(np.int64)
            texts = decode_ids(tokenizer, ids, np.array([len(x) for x in parts], np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


DIGESTS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() and then decode() give, in one pass that keeps the ids in the worker."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in units(batches):
            ids, counts = encoder(tokenizer, "prefix").encode(b.column("text"))
            texts = decode_ids(tokenizer, ids, counts)
            data, ends = memoryview(ids.astype("<u4").tobytes()), (np.cumsum(counts) * 4).tolist()
            out = batch(DIGESTS, n_tokens=counts, ids_sha256=[sha(data[e - 4 * n : e]) for e, n in zip(ends, counts.tolist())], decoded_sha256=[sha(t.encode()) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out.columns], names=["doc_id", *DIGESTS.names])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
