"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.storage import scratch

#: White space that separates words: blank and \x09 to \x0D, which is what ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch hold at most about this many bytes of text once they are cut up by ``small_batches``.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``: the fold of a labelled row (null for null)."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def small_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of about ``BATCH_BYTES``, so Python objects are made for few texts at a time.

    After the last one memory that is free goes back to the system: Spark uses a worker again for tasks of other stages.
    """
    for b in batches:
        step = max(1, min(b.num_rows, int(b.num_rows * BATCH_BYTES / max(1, b.nbytes))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    b = None
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Caps the rows of an Arrow batch in this session, as Spark counts rows and not bytes, and texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
