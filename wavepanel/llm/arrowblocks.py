"""Arrow batches in parts of bounded bytes, and string columns as numpy bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PART = 4 << 20  # bytes of text that are worked on together


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one text after the other, and where each begins (one more entry than texts); null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def strings(texts: list[bytes | None]) -> pa.Array:
    """A string column of UTF-8 bytes, taken as they are."""
    made = pa.array(texts, pa.large_binary())
    return pa.LargeStringArray.from_buffers(len(made), made.buffers()[1], made.buffers()[2], made.buffers()[0]).cast(pa.string())


def parts(batch: pa.RecordBatch, column: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text together, or one longer text."""
    if not batch.num_rows:
        return
    ends = utf8(batch.column(column))[1][1:]
    lo = 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def schema_of(rest: DataFrame, added: str) -> str:
    """DDL of the columns of ``rest`` and those added."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), added])
