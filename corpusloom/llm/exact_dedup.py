"""Exact dedup on a persistent digest index, bucketed and sorted by hash. Built-in functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.files import load_once

from .common import shared_dir, stored, table

#: White space that counts as one space.
SPACE = r"[\x20\x09-\x0D]+"
#: Parts in which the rows of one digest are counted before they meet, and joined with what stays.
SALTS = 64


def digest(text: Column) -> Column:
    """SHA-256, 32 bytes, of a text whose runs of white space are one space each; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


def digests(docs: DataFrame, batch: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, id, row, salt, batch) of each row of docs, written once: texts are read a single time and never shuffled."""
    row = F.monotonically_increasing_id()
    rows = docs.select(digest(F.col(text)).alias("digest"), F.col(key).cast("long").alias("id"), row.alias("row"), batch.cast("string").alias("batch"))
    return stored(rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")))


class DigestIndex:
    """The texts seen so far: one row (digest, id, batch, row) each, in a table bucketed and sorted by digest at `path`.

    The table outlives the session: opening the path again finds it, with the number of buckets it was made with (as many as
    there are shuffle partitions then, unless given). Appends are commits of a whole batch, so a batch that failed or whose
    executors were lost is simply added again, and one added twice changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        made = spark.range(1).select(F.lit(buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))).alias("buckets"))
        load_once(spark, made, f"{path}/made")
        self.spark, self.path = spark, path
        self.buckets = spark.read.parquet(f"{path}/made").first()[0]
        self.name = f"digests_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, id BIGINT, batch STRING, row BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/index'")

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Append the digests of rows (digest, id, row, salt, batch) that the index hasn't: of equal ones the smallest id, nulls last.

        Rows of one digest meet in SALTS parts before they meet as one; the index is anti-joined by merging its buckets with
        the batch, which alone is dealt.
        """
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "batch")).alias("first")
        parts = stored(rows.groupBy("digest", "salt").agg(first))  # stored, as the join would else be moved below the aggregation
        batch = parts.repartition(self.buckets, "digest").groupBy("digest").agg(F.min("first").alias("first"))
        new = batch.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        new.select("digest", "first.id", "first.batch", "first.row").write.insertInto(self.name)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """rows with keep_id, the id of the row that stays, kept, whether it is this one, and group_size, equal ones among rows.

        All rows must have been added. Counts go by (digest, salt) first; what stays comes back by the same key, so a digest that
        many rows share is dealt to SALTS tasks.
        """
        parts = rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"))
        sizes = parts.repartition(self.buckets, "digest").groupBy("digest").agg(F.sum("n").alias("group_size"))
        stays = sizes.hint("merge").join(self.read().select("digest", F.col("id").alias("keep_id"), F.struct("batch", "row").alias("its")), "digest")
        found = rows.join(parts.select("digest", "salt").join(stays, "digest"), ["digest", "salt"])
        return found.withColumn("kept", F.struct("batch", "row") == F.col("its")).drop("its")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group, over an index that takes the documents in two batches by id.

    The second batch meets the first's digests in the index, as new data would; ids of the first are smaller, so the
    smallest id of all stays. Null texts count as empty, texts are read whole, and null ids stay only where a group has
    no other; of repeated rows one is kept. An empty table gives no rows; other columns aren't read, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    later = F.coalesce(F.col("doc_id") > F.lit(((low or 0) + (high or 0)) // 2), F.lit(True))
    rows = digests(docs, F.when(later, "1").otherwise("0"))
    index = DigestIndex(spark, f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}")
    index.add(rows.where("batch = '0'"))
    index.add(rows.where("batch = '1'"))
    return index.resolve(rows).select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = r"""WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)"""
