"""Work of tasks on Arrow batches, in Python workers that stay small.

An executor's memory holds, beside the heap of its JVM, each batch on its way to a worker and what the worker has. By itself Spark
puts 10,000 rows into a batch, however long their texts are, and a worker that is used again keeps what its last task has freed. So
batches end at some bytes, and a worker gives back what a task has left.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes at which a batch ends; it has at least one row.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES in this session, unless it has chosen a size of its own."""
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # not glibc


def in_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(work, schema)`` by limited batches, after which a worker gives back memory."""
    limit_batches(df.sparkSession)

    def task(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)
