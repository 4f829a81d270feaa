"""Arrow helpers shared by the operators that run Python inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import canasta


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most `most` bytes together; an item larger than that is a range of its own."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if sizes:
        yield begin, len(sizes)


# Texts and vectors are large: 10,000 of them in one Arrow batch fill a worker's memory. A session's own setting wins.
BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BYTES, BATCH_BYTES = "67108864b", str(4 << 20)


def deliver(spark: SparkSession) -> None:
    """Prepare a session for Python inside tasks: Arrow batches of bounded bytes, and this package for the workers of a local session,
    wherever it was started. On a cluster the package is installed or sent along (`--py-files`), as any library."""
    if spark.conf.get(BYTES_PER_BATCH, None) == DEFAULT_BYTES:
        spark.conf.set(BYTES_PER_BATCH, BATCH_BYTES)
    context = spark.sparkContext
    folder = Path(canasta.__file__).parent
    if context.master.split("[")[0] == "local" and not any(f.rstrip("/").endswith(f"/{folder.name}") for f in context.listFiles):
        context.addFile(str(folder), recursive=True)


def give_back() -> None:
    """Return free memory of Arrow and of the C library, which otherwise keeps freed arrays, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """`mapInArrow` in a prepared session; a task gives back free memory at its end, for workers live on."""
    deliver(df.sparkSession)

    def task(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)
