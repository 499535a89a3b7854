"""Small helpers for functions that see a task's rows as Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``most`` bytes in each part; a longer text stands alone."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts(batch: pa.RecordBatch, column: str | int) -> pa.Array:
    """The column as large_string, null as empty. Its data are copied: ascii_lower misreads offsets that do not start at
    zero, as a slice's do."""
    own = batch.column(column).take(pa.array(np.arange(batch.num_rows)))
    return pc.fill_null(own.cast(pa.large_string()), "")


def words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of anything but ASCII white space: (row of each word, its index among the distinct words, those)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return row[full.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
