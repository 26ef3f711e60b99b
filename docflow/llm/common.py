"""What the operators share: tables, the checkpoint folder, Arrow slices."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 2_000  # rows of an Arrow batch; Spark's own 10,000 documents take too much memory on either side

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = lambda keep: 0


def release() -> None:
    """Give memory that a task no longer needs back to the system: workers are used again, by tasks of other operators too."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS where they are larger."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder that spark.checkpoint.dir names. Only a local session, as in tests, gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docflow-"))
    return df.checkpoint()


def free(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case of its letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Mark df for broadcast if it has at most limit rows; else a join shuffles it. df should be cheap to count (checkpointed)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about most_bytes of the binary column, or one row; memory is released at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.diff(raw(batch.column(column))[1]))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary or string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and null mask of an integer column."""
    column = column.cast(pa.int64())
    return column.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(column.is_null())
