"""Numbers by day that go on across batches and restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.documents import numbered


def _path(folder: str, kind: str, batch: int) -> str:
    return f"{folder}/{kind}/batch={batch}"


def number_batch(spark: SparkSession, rows: DataFrame, batch: int, folder: str) -> None:
    """Number one batch of rows (id, day, ...) and keep the last number of each day for the next.

    A day's numbers start at 1 and go on where the batch before ended, in order of id. A batch that is run again reads the same state and
    writes over what it wrote, so numbers stay as they were. A day of any size is numbered in blocks, not in one task.
    """
    kept = None
    if batch > 0:
        kept = spark.read.parquet(_path(folder, "last", batch - 1))
    own = numbered(rows, "day", "id", "number")
    if kept is not None:
        own = own.join(kept, "day", "left").withColumn("number", F.col("number") + F.coalesce("last", F.lit(0))).drop("last")
    own.write.mode("overwrite").parquet(_path(folder, "rows", batch))
    last = spark.read.parquet(_path(folder, "rows", batch)).groupBy("day").agg(F.max("number").alias("last"))
    if kept is not None:
        last = last.unionByName(kept).groupBy("day").agg(F.max("last").alias("last"))
    last.write.mode("overwrite").parquet(_path(folder, "last", batch))


def number_by_day(rows: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start numbering a stream of rows (id, day, ...) into folder/rows; folder must be shared by the cluster. Started again on the same folder it goes on where it ended."""

    def each(batch_rows: DataFrame, batch: int) -> None:
        number_batch(batch_rows.sparkSession, batch_rows, batch, folder)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()


def numbered_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that have been numbered."""
    return spark.read.parquet(f"{folder}/rows").drop("batch")
