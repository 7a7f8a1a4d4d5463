"""Semantic cache as tables: lookup by hash, by similarity and in tiers; upsert, expiry and invalidation by lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import contains_any

from .vectors import dense_topk

#: Similarity of a hit, and days that an entry lives.
THRESHOLD, TTL_DAYS = 0.97, 7


def lookup_exact(probes: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Probes (query_hash) with `hit`, the id of an unexpired entry with the same hash."""
    live = cache.where(F.col("expires_at") > as_of).groupBy("query_hash").agg(F.min("entry_id").alias("hit"))
    return probes.join(live, "query_hash", "left")


def lookup_similar(probes: DataFrame, cache: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, nearest, sim, is_hit): the nearest live entry, tested against the threshold after the choice. cache: id, vec."""
    found = dense_topk(probes, cache, 1, -1.0, other_only=True)
    return found.select("query_id", F.col("id").alias("nearest"), "sim", (F.col("sim") >= threshold).alias("is_hit"))


def lookup_tiered(probes: DataFrame, cache: DataFrame, as_of: Column, terms: tuple[str, ...], threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, path): negative, exact, similar or miss. Each tier sees only what the one before missed.

    probes: query_id, text, query_hash, vec; cache: entry_id, query_hash, vec, expires_at.
    """
    negative = contains_any(F.col("text"), terms)
    first = lookup_exact(probes.withColumn("negative", negative), cache, as_of)
    told = first.withColumn("path", F.when(F.col("negative"), "negative").when(F.col("hit").isNotNull(), "exact"))
    rest = told.where("path IS NULL AND vec IS NOT NULL").select("query_id", "vec")
    live = cache.where((F.col("expires_at") > as_of) & F.col("vec").isNotNull()).select(F.col("entry_id").alias("id"), "vec")
    near = lookup_similar(rest, live, threshold).where("is_hit").select("query_id", F.lit("similar").alias("near"))
    return told.join(near, "query_id", "left").select("query_id", F.coalesce("path", "near", F.lit("miss")).alias("path"))


def upsert(cache: DataFrame, batch: DataFrame) -> DataFrame:
    """A new snapshot, one row a hash. The batch's last row by ts gives answer and expiry; text, lineage and birth stay.

    Both: query_hash, query_text, answer, doc_ids, created_at, expires_at; the batch has ts too.
    """
    cols = ["query_text", "answer", "doc_ids", "created_at", "expires_at"]
    last = batch.groupBy("query_hash").agg(F.max_by(F.struct(*cols), F.struct("ts", "answer")).alias("new"))
    both = cache.select("query_hash", F.struct(*cols).alias("old")).join(last, "query_hash", "full_outer")
    pick = lambda c: F.coalesce(*([f"new.{c}", f"old.{c}"] if c in ("answer", "expires_at") else [f"old.{c}", f"new.{c}"])).alias(c)
    return both.select("query_hash", *[pick(c) for c in cols])


def expire(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.where(~(F.col("expires_at") < as_of))


def lineage(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """Hashes of entries that name a changed document: exploded ids semi-joined, not a scan per id."""
    return cache.select("query_hash", F.explode("doc_ids").alias("doc_id")).join(changed.select("doc_id"), "doc_id", "left_semi").select("query_hash").distinct()


def invalidate(cache: DataFrame, changed: DataFrame) -> DataFrame:
    return cache.join(lineage(cache, changed), "query_hash", "left_anti")


def clear(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def cacheable(answers: DataFrame) -> DataFrame:
    return answers.where("grounded AND NOT bypassed")


def _kind(v: Column) -> Column:
    """The kind of a variant: OBJECT, ARRAY, STRING and so on; null for none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def parse_payload(raw: Column) -> tuple[Column, Column]:
    """(answer, sources) of a cached JSON payload: an answer that isn't a string is empty, and only objects and arrays are sources, as JSON."""
    v = F.try_parse_json(raw)
    answer = F.try_variant_get(v, "$.answer", "variant")
    listed = F.coalesce(F.try_variant_get(v, "$.sources", "array<variant>"), F.array().cast("array<variant>"))
    kept = F.filter(listed, lambda x: F.coalesce(_kind(x).isin("OBJECT", "ARRAY"), F.lit(False)))
    return F.when(_kind(answer) == "STRING", F.try_variant_get(v, "$.answer", "string")).otherwise(""), F.transform(kept, lambda x: F.to_json(x))


_SOURCE = "array<struct<name:string,url:string,score:double,documentId:string>>"


def parse_sources(raw: Column) -> Column:
    """Sources (name, url, score, documentId) of a JSON list; none at all if one entry lacks a part or has one of another kind."""
    v = F.try_parse_json(raw)
    listed = F.try_variant_get(v, "$", "array<variant>")
    kind = lambda x, name: _kind(F.try_variant_get(x, f"$.{name}", "variant"))
    number = lambda x: kind(x, "score").isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    fits = lambda x: (kind(x, "name") == "STRING") & (kind(x, "url") == "STRING") & number(x) & F.coalesce(kind(x, "documentId") == "STRING", F.lit(True))
    good = F.forall(listed, lambda x: F.coalesce(fits(x), F.lit(False)))
    return F.coalesce(F.when(F.coalesce(good, F.lit(False)), F.from_json(raw, _SOURCE)), F.array().cast(_SOURCE))
