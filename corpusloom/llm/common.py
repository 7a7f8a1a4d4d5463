"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import workspace

#: What may be broadcast, in bytes of its columns; beyond it joins shuffle.
BROADCAST_BYTES = 16 << 20


#: Rows of an Arrow batch at most. Texts may be long, and a worker holds a batch in several forms.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(_ARROW)) <= ARROW_ROWS:
        spark.conf.set(_ARROW, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, in a session whose Arrow batches hold ARROW_ROWS rows at most."""
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as workspace.shared_dir() finds it."""
    _small_batches(spark)
    return workspace.shared_dir(spark)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small iterative frame with a reliable checkpoint in the shared folder."""
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: columnar, compressed, and safe from lost executors.

    The files go when the application ends.
    """
    path = work_dir(df.sparkSession, "stored")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    _small_batches(spark)
    return workspace.work_dir(spark, name)


def stored_by_task(df: DataFrame) -> DataFrame:
    """stored(), with `task`, the number of the task that wrote a row, as its bucket: nothing is dealt for that.

    Rows told by (task, row), where row is what monotonically_increasing_id() gave them, then join these where they lie, so wide rows don't move
    however many of them are asked for; on_task() puts `task` beside such a row number.
    """
    spark = df.sparkSession
    path, name = work_dir(spark, "by-task"), f"by_task_{uuid.uuid4().hex}"
    rows = df.withColumn("task", F.spark_partition_id())
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "task").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def on_task(df: DataFrame, row: str) -> DataFrame:
    """df with `task`, where the row with that number was written, to be sent to the rows of stored_by_task() and hashed there."""
    return df.withColumn("task", F.shiftright(row, 33).cast("int")).hint("shuffle_hash")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(df: DataFrame, rows: int, width: int = 8) -> DataFrame:
    """Hint a broadcast only when the counted rows, of `width` bytes each, stay under BROADCAST_BYTES; otherwise leave a shuffled join."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a function of one batch. At a task's end the memory pool gives back what it holds."""

    def run(batches):
        for batch in batches:
            out = fn(batch) if batch.num_rows else None
            if out is not None and out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()

    return run
