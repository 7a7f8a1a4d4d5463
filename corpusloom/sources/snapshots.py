"""Documents and chunks as versions of buckets: a sync rewrites the buckets it changes, and one log entry makes them current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.sync import apply_sync, classify

from .workspace import stored

BUCKETS = 64


class Snapshots:
    """Tables at `path`: documents (doc_id, title, hash) and chunks, partitioned by version and bucket of documents, and a log.

    A log entry is one file, named by its batch, that says which version holds each bucket; the last entry is the snapshot.
    Readers see the old snapshot until the file is there, and the new one from then on. A batch that is logged isn't applied again,
    so replays and restarts change nothing; one that failed before overwrites what it left. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, chunk_schema: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schemas = {"documents": "doc_id long, title string, hash string", "chunks": chunk_schema}

    def log(self) -> DataFrame:
        """(batch, bucket, version, changes): for each batch the version of every bucket so far, and its counts by change as JSON."""
        files = self.spark.read.schema("batch long, bucket int, version long, changes string").option("recursiveFileLookup", True)
        return files.parquet(f"{self.path}/log") if self._exists(f"{self.path}/log") else self.spark.createDataFrame([], "batch long, bucket int, version long, changes string")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _current(self) -> tuple[int, dict[int, int]]:
        """The last batch, and the version of each bucket; there are as many as buckets."""
        log = self.log()
        last = log.agg(F.max("batch")).first()[0]
        return (-1, {}) if last is None else (last, {r["bucket"]: r["version"] for r in log.where((F.col("batch") == last) & F.col("bucket").isNotNull()).collect()})

    def _read(self, table: str, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schemas[table])
        found = self.spark.read.schema(f"{self.schemas[table]}, version long, bucket int").option("basePath", f"{self.path}/{table}")
        paths = [p for b, v in versions.items() if self._exists(p := f"{self.path}/{table}/version={v}/bucket={b}")]
        return found.parquet(*paths).drop("version", "bucket") if paths else self.spark.createDataFrame([], self.schemas[table])

    def read(self, table: str) -> DataFrame:
        """The current documents or chunks."""
        return self._read(table, self._current()[1])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, number: int, chunk: Callable[[DataFrame], DataFrame], order: list[str] | None = None) -> bool:
        """Bring in a batch (doc_id, title, text) under its number; says whether it did, or had before.

        Documents are told by hash: created, updated, retitled, skipped or failed (no text). chunk makes rows of the chunk schema
        from documents; only created and updated ones are chunked. Of a document that a batch brings twice, the last by
        `order`, else the greatest title and text, counts. Only buckets with a change are read whole and written.
        """
        last, versions = self._current()
        if number <= last:
            return False
        once = Window.partitionBy("doc_id").orderBy(*[F.desc(c) for c in order or ["title", "text"]])
        new = stored(batch.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n").withColumn("hash", F.sha2("text", 256)).withColumn("bucket", self._bucket()))
        touched = {r[0] for r in new.select("bucket").distinct().collect()}
        old = self._read("documents", {b: v for b, v in versions.items() if b in touched})
        changes = stored(classify(old, new.select("doc_id", "title", "hash")).withColumn("bucket", self._bucket()))
        counts = changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
        told = counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("change", "n")))))).first()[0]
        moved = changes.where(F.col("change").isin("created", "updated", "retitled"))
        written = {r[0] for r in moved.select("bucket").distinct().collect()}
        if written:
            before = {b: v for b, v in versions.items() if b in written}
            fresh = new.join(moved.where("change <> 'retitled'").select("doc_id"), "doc_id", "left_semi")
            documents = new.join(moved.select("doc_id"), "doc_id", "left_semi").select("doc_id", "title", "hash")
            kept = self._read("documents", before).join(moved.select("doc_id"), "doc_id", "left_anti")
            self._write("documents", kept.unionByName(documents), number)
            self._write("chunks", apply_sync(self._read("chunks", before), changes, chunk(fresh)), number)
        versions = versions | {b: number for b in written}
        rows = [(number, b, v, told) for b, v in sorted(versions.items())] or [(number, None, None, told)]
        self.spark.createDataFrame(rows, "batch long, bucket int, version long, changes string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{number:020d}")
        return True

    def _write(self, table: str, rows: DataFrame, version: int) -> None:
        rows = rows.withColumn("version", F.lit(version)).withColumn("bucket", self._bucket())
        # a bucket's rows go to few tasks, but a large one isn't written by a single task
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(f"{self.path}/{table}")
