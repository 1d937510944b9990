"""Arrow batches inside tasks: bounded slices, byte buffers, added columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from . import words

SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose ``column`` holds about ``most`` bytes; one row
    at least, so a very long text stands alone."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the n + 1 offsets of its
    rows; null is empty."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and
    idle ones would hold what their largest batch took."""
    words.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving memory back when its task ends."""

    def wrapped(stream):
        try:
            yield from run(stream)
        finally:
            give_back()

    return wrapped


def add_columns(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Adds ``fields`` to each row. ``make()`` runs once a task and gives a
    function from a slice (bounded by the bytes of ``column``) to the arrays
    of the new columns; if that has an attribute ``close``, it is called at the
    task's end. Columns of the same names are replaced."""
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    names = [f.name for f in kept]

    def run(stream):
        work = make()
        try:
            for batch in stream:
                for part in slices(batch, column):
                    arrays = [part.column(n) for n in names] + work(part)
                    yield pa.RecordBatch.from_arrays(arrays, [*names, *(f.name for f in fields)])
        finally:
            if hasattr(work, "close"):
                work.close()

    return df.mapInArrow(returning(run), T.StructType([*kept, *fields]))
