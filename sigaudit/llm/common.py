"""Shared helpers of the corpus operators: tables, scratch tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scratch

#: Rows and bytes of one Arrow batch sent to a Python worker: bounds a worker's memory when some texts are very long.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Bytes of text that the vectorised kernels handle at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


#: What a worker process keeps from one task to the next of a step, such as a tokenizer.
kept: dict[tuple, object] = {}


def _trim() -> None:
    """Memory that the C library holds and nothing uses goes back to the system, where it can do that."""
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def _forget() -> None:
    if kept:
        kept.clear()
        _trim()


def lean(run: Run, keeps: bool = False) -> Run:
    """run, which works on the batches of a task, so that a worker, which outlives its task and serves all steps, holds little beside
    what run uses: what Arrow's allocator has left over goes back after each batch, what the C library has at the end, and what
    another step kept goes at the start (unless run is one that keeps something)."""

    @functools.wraps(run)
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _forget()
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
        _trim()

    return released


def save(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read again, and its path. Shuffle files of finished jobs go only when the driver's
    JVM collects its garbage, which an idle driver may put off for half an hour while the executors' disks fill: so that is asked for."""
    out = scratch.save(df)
    df.sparkSession._jvm.System.gc()
    return out


drop = scratch.drop


def held_out(doc_id="doc_id"):
    """True for the rows that no label may be learned from: crc32 of the decimal id is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets, without copying; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
        keep = np.repeat(np.asarray(column.is_valid()), np.diff(at))
        raw, at = raw[at[0] : at[-1]][keep], np.concatenate([[0], np.cumsum(lengths)])
    return raw, at


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one longer row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
