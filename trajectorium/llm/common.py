"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a Python worker holds as one unit of work.
UNIT_BYTES = 2 << 20


def units(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = UNIT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with about `most` bytes of the column, one row at least. At the end the worker gives back memory that it doesn't use."""
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(lengths)
        start = 0
        while start < n:
            before = at[start - 1] if start else 0
            end = max(int(np.searchsorted(at, before + most, "right")), start + 1)
            yield b.slice(start, end - start)
            start = end
    give_back()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no such column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def strings(column: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of counts[i] values."""
    at = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(counts)
    return at[ends] - at[ends - counts]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
