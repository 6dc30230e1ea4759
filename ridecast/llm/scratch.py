"""Small helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.session import materialise, ship_package

ROWS_SETTING, ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"
BYTES_SETTING, BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of texts whose words are hashed at once; a byte takes some 50 bytes meanwhile, and a worker keeps some 16 of them.
HASHED_BYTES = 256 << 10


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application, so that they need no copy of their own.

    Rows of text are wide: unless the session has its own bounds, batches between the JVM and
    the workers get fewer rows and bytes, which bounds the memory of both. Shuffle files go when their
    query ends, not when the driver happens to collect its garbage.
    """
    if spark.conf.get(CLEANUP_SETTING, None) is None:
        spark.conf.set(CLEANUP_SETTING, "true")
    if spark.conf.get(BYTES_SETTING) in ("67108864", "67108864b", "64MB", "-1"):  # Spark's defaults
        spark.conf.set(BYTES_SETTING, BYTES_PER_BATCH)
    if spark.conf.get(ROWS_SETTING) == "10000":  # Spark's default
        spark.conf.set(ROWS_SETTING, ROWS_PER_BATCH)
    ship_package(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, safe against lost executors."""
    return materialise(df, re.sub(r"\W+", "-", name))


def held_out_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo `modulus`; a null id gives 0 (crc32 of the empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def give_back_memory() -> None:
    """Return what a process no longer uses to the system: workers and the driver live on, beside the JVM."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc alone has it
        trim(0)


def text_chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow text column into runs of rows of about `most_bytes` bytes.

    Yields (first row, end row, bytes, offsets); a null text has no bytes. One text longer
    than the bound is a run of its own, so whole texts are always seen together.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + most_bytes, "right")) - 1)
        end = min(end, n)
        yield first, end, flat[ends[first] : ends[end]], ends[first : end + 1] - ends[first]
        first = end
    give_back_memory()
