"""What the operators of this folder share: table access, written intermediate tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir, table, written

__all__ = ["as_bytes", "buffers", "map_batches", "shared_dir", "small_batches", "table", "worker_cache", "written"]

#: Rows that one Arrow batch holds at most; the longest texts are then still a bounded batch.
BATCH_ROWS = 500
_caches: dict[str, dict] = {}

def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that are sent to Python by rows, and by bytes where Spark knows the setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def worker_cache(module: str) -> dict:
    """A dict that lives in a worker process as long as only that module's functions run there."""
    return _caches.setdefault(module, {})


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df through fn. A worker that goes on to another operator first lets go of what it held for the last one."""
    small_batches(df.sparkSession)
    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(module)
        return fn(batches)

    return df.mapInArrow(run, schema)


def drop_caches(but: str) -> None:
    for name, cache in _caches.items():
        if name != but:
            cache.clear()


def as_bytes(name: str = "text"):
    """The UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the row's offsets in them; copies nothing."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]
