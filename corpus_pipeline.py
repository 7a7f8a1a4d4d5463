"""The corpus pipeline: toxic documents go, near duplicates go, benchmark leaks go, secrets are masked, and the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, near_dedup, packing, secret_scan, toxicity
from corpusloom.llm.common import table, work_dir

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("secrets", secret_scan.stage),
    ("packing", packing.stage),
]

#: No SQL: the stages use a fitted model, hashing minima, a search index and a tokenizer. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet in the shared folder and read as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
