"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie in one numpy array; each round merges
every sequence's lowest-rank pair in all sequences at once, and the symbols
that survive are the count. See bpe.rank_synchronous.

Null and empty texts have 0 bytes and 0 tokens; texts are taken whole. Rows are
independent: repeated rows repeat their result, an empty table gives an empty
one, and other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .bpe import encoder
from .common import units


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes long, n_tokens long, over_limit boolean (more than `limit` tokens)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches):
            n = encoder(tokenizer, "rank").counts(b.column("text"))
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
