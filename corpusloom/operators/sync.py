"""Incremental document sync: new snapshots and change summaries; a writer swaps directories afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def classify(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """(doc_id, change): created, updated, skipped, retitled (same text, other title) or failed (no text). Both: doc_id, title, hash."""
    both = new.join(old.select("doc_id", F.col("title").alias("old_title"), F.col("hash").alias("old_hash")), "doc_id", "left")
    same = (F.col("hash") == F.col("old_hash")) & ~F.lit(force)
    change = (
        F.when(F.col("hash").isNull(), "failed")
        .when(F.col("old_hash").isNull(), "created")
        .when(same & ~F.col("title").eqNullSafe(F.col("old_title")), "retitled")
        .when(same, "skipped")
        .otherwise("updated")
    )
    return both.select("doc_id", change.alias("change"))


def apply_sync(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks after a sync: those of created and updated documents come from `fresh`, others stay."""
    replaced = changes.where(F.col("change").isin("created", "updated")).select("doc_id")
    return chunks.join(replaced, "doc_id", "left_anti").unionByName(fresh.join(replaced, "doc_id", "left_semi").select(chunks.columns))


def retitle(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """Chunks with the source names of documents whose title changed. titles: doc_id, new_title."""
    return chunks.join(titles, "doc_id", "left").withColumn("title", F.coalesce("new_title", "title")).drop("new_title")


def cascade_delete(tables: Mapping[str, DataFrame], removed: DataFrame, key: str = "doc_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of removed documents, and (table, deleted) counts."""
    kept = {name: df.join(removed.select(key), key, "left_anti") for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        n = df.join(removed.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def mutate(rows: DataFrame, keys: DataFrame, key: str, owner: Column, changes: Mapping[str, Column]) -> DataFrame:
    """Rows with the changes set where the key is listed and the owner agrees: soft delete, restore, pin, rename."""
    marked = rows.join(keys.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    for name, value in changes.items():
        marked = marked.withColumn(name, F.when(F.coalesce("__hit", F.lit(False)) & owner, value).otherwise(F.col(name)))
    return marked.drop("__hit")


def backfill_parent(rows: DataFrame, parents: DataFrame, key: str, legacy: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a parent get the legacy one, which is added to the parents if any row needs it and it isn't there."""
    filled = rows.withColumn(key, F.coalesce(key, F.lit(legacy)))
    added = rows.where(F.col(key).isNull()).limit(1).select(F.lit(legacy).alias(key))
    return filled, parents.unionByName(added.join(parents.select(key), key, "left_anti"), allowMissingColumns=True)


def latest(log: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The last value per key; keys whose last value is null are removed."""
    return log.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value)).where(F.col(value).isNotNull())


def claim(rows: DataFrame, guests: DataFrame, user: str, item: str, tie: str) -> DataFrame:
    """Rows of guests move to their account; where both have the item, the account's row wins. guests: guest, account."""
    moved = rows.join(guests, rows[user] == guests["guest"], "left").withColumn("is_account", F.col("guest").isNull()).withColumn("owner", F.coalesce("account", user))
    best = Window.partitionBy("owner", item).orderBy(F.desc("is_account"), tie)
    return moved.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "guest", "account")


def reconcile_jobs(jobs: DataFrame, as_of: Column, lease_minutes: int = 10, most: int = 3, keep_hours: int = 24) -> DataFrame:
    """Jobs (id, url, status, attempts, started_at, finished_at) with expired leases requeued or failed, old ones pruned,
    and one pending job a url."""
    expired = (F.col("status") == "RUNNING") & (F.col("started_at") < as_of - F.make_dt_interval(mins=F.lit(lease_minutes)))
    status = F.when(expired & (F.col("attempts") < most), "QUEUED").when(expired, "FAILED").otherwise(F.col("status"))
    old = F.col("status").isin("DONE", "FAILED") & (F.col("finished_at") < as_of - F.make_dt_interval(hours=F.lit(keep_hours)))
    now = jobs.where(~F.coalesce(old, F.lit(False))).withColumn("status", status)
    first = F.row_number().over(Window.partitionBy("url", F.col("status") == "QUEUED").orderBy("id"))
    return now.withColumn("__n", first).where("status <> 'QUEUED' OR __n = 1").drop("__n")
