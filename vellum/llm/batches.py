"""Helpers for functions that map Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: What an operator keeps between the tasks of a Python worker, by name: how to let go of it.
_kept: dict[str, Callable[[], None]] = {}


def sole(name: str, forget: Callable[[], None] | None = None) -> None:
    """From now on this worker serves the operator ``name``: what others keep in it is dropped."""
    others = [k for k in _kept if k != name]
    for k in others:
        _kept.pop(k)()
    if others:
        gc.collect()
    if forget:
        _kept[name] = forget


@cache
def _libc() -> ctypes.CDLL | None:
    """The C library, told to hand large blocks back as soon as they are free."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "mallopt") or not hasattr(libc, "malloc_trim"):
        return None
    libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD of malloc.h
    return libc


def rest() -> None:
    """Give memory that is free back to the system; idle workers count as the executor's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


#: Bytes that go to a Python worker at a time, whatever the number of rows.
BATCH_BYTES = 4 << 20
_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with :func:`rest` at the end of each task.

    The session's bound of an Arrow batch in bytes is lowered to ``BATCH_BYTES``; a lower one stays.
    Without it a batch of long texts is as large as 10,000 of them.
    """
    conf = df.sparkSession.conf
    parse = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < parse(conf.get(_BYTES_KEY)) <= BATCH_BYTES:
        conf.set(_BYTES_KEY, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _libc()
        try:
            yield from run(batches)
        finally:
            rest()

    return df.mapInArrow(task, schema)


#: Python objects are made for this many bytes of text at a time, whatever a batch holds.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``size`` bytes of ``column`` each (one row at least)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The columns ``keep`` of ``batch`` followed by ``new``."""
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(new.values()), [*keep, *new])
