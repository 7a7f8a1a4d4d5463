"""Queries bind operators to the tables and hold the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import non_empty, strip
from corpusloom.sources.files import spread

Query = Callable[[SparkSession, str], DataFrame]

#: The time that windows look back from.
AS_OF = "timestamp '2024-01-31 00:00:00'"
#: Non-empty lines of documents stand for chunks; five make a parent.
LINES_SQL = "SELECT doc_id, line_no, line_no // 5 AS parent_no, text FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE text <> ''"


class Registry:
    """Collects queries by name with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.oracles[name] = sql

    def on(self, name: str, source: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        """A query of one table."""
        self.add(name, lambda spark, d: build(load(spark, d, source)), sql)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages"):  # work on texts outweighs the scan
        df = spread(df)
    if name == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df


def lines(docs: DataFrame) -> DataFrame:
    """Proxy chunks: doc_id, line_no, parent_no, text."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where("text <> ''")
    return each.select("doc_id", F.col("line_no").cast("long"), F.floor(F.col("line_no") / 5).alias("parent_no"), "text")


__all__ = ["AS_OF", "LINES_SQL", "Query", "Registry", "lines", "load", "non_empty", "strip"]
