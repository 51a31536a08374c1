"""Shared by the operators: table access, durable intermediate tables, Arrow helpers.

Where an operator adds columns to a table, they come last, and columns of the same names give way (with_fields).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from quillstone.tables import discard, durable, shared_dir, table

__all__ = ["discard", "durable", "extended", "shared_dir", "slices", "small_batches", "table", "text_sizes", "utf8", "with_fields"]


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """schema with fields at its end; columns of the same names give way."""
    names = {f.name for f in fields}
    return T.StructType([f for f in schema.fields if f.name not in names] + list(fields))


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about limit bytes each; a longer row has a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_sizes(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each string, null as 0."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text."""
    for batch in batches:
        for a, b in slices(text_sizes(batch.column(batch.schema.get_field_index(column))), limit):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on after a task, and what they keep counts beside the next."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The strings of a column as bytes, without decoding them."""
    import pyarrow.compute as pc

    return pc.cast(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def extended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """batch with columns at its end; columns of the same names give way."""
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + list(columns.values()), names=names + list(columns))
