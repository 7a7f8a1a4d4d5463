"""The folder that driver and executors share, for intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if Spark runs in this process alone, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="corpusloom-"))


def work_dir(spark: SparkSession, name: str = "work") -> str:
    """A new path in the shared folder, below one folder of the application, which goes when the application ends."""
    context = spark.sparkContext
    top = f"{shared_dir(spark)}/corpusloom-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(top)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{top}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch at most where it holds texts, which may be long.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet in the shared folder and read back: computed once, and safe from lost executors."""
    path = work_dir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
