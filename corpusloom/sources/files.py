"""Sources and sinks: manifests, raw text folders, chunk and embedding writers, guarded loads and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

from .workspace import stored

MANIFEST = "url string, pdf string, title string"


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(url, pdf, title) of a JSON array; entries without url and pdf are dropped."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).where("url IS NOT NULL OR pdf IS NOT NULL")


def parse_manifest_lines(lines: Column) -> Column:
    """A manifest line as struct (kind, value, title): an object, a JSON string or a plain address; null if none of them.

    Comments and blank lines give null, as does JSON that is no entry.
    """
    text = strip(lines)
    parsed = F.try_parse_json(text)
    get = lambda path: F.try_variant_get(parsed, path, "string")
    kind = F.schema_of_variant(parsed)
    entry = lambda k, v, t: F.struct(F.lit(k).alias("kind"), v.alias("value"), t.alias("title"))
    none = F.lit(None).cast("string")
    return (
        F.when((text == "") | F.startswith(text, F.lit("#")), None)
        .when(parsed.isNull(), entry("url", text, none))
        .when(kind == "STRING", entry("url", get("$"), none))
        .when(F.startswith(kind, F.lit("OBJECT")) & get("$.url").isNotNull(), entry("url", get("$.url"), get("$.title")))
        .when(F.startswith(kind, F.lit("OBJECT")) & get("$.pdf").isNotNull(), entry("pdf", get("$.pdf"), get("$.title")))
    )


def parse_batch_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries (kind, value, title) of one file: a JSON array, or lines."""
    whole = spark.read.text(path, wholetext=True)
    items = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    lines = F.coalesce(F.transform(items, lambda x: F.to_json(x)), F.split("value", r"\r?\n"))
    return whole.select(F.explode(lines).alias("line")).select(parse_manifest_lines(F.col("line")).alias("e")).where("e IS NOT NULL").select("e.*")


def scan_raw_text(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """(name, text) of the folder's .txt files that the manifest names; names: name. Missing files give no row."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("name"), F.col("value").alias("text"))
    return files.join(names.select("name").distinct(), "name", "left_semi")


def scan_corpus(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The columns asked for and no others; pages are the files' splits."""
    return spark.read.parquet(path).select(*columns)


def write_chunks(chunks: DataFrame, path: str, kind: str = "parquet") -> None:
    chunks.write.mode("overwrite").format(kind).save(path)


def with_place(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`, places from 0 without gaps in the order of the columns, whose values are of any kind.

    The rows are dealt into ranges of that order and sorted there; counts of the ranges, one row each, give where each range
    starts. What is sampled for the ranges decides their sizes only. No window sees more than the counts.
    """
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = stored(sorted_.withColumn("__range", F.shiftright(at, 33).cast("int")).withColumn("__at", at.bitwiseAND((1 << 33) - 1)))
    counts = sorted(map(tuple, rows.groupBy("__range").count().collect()))
    starts = list(accumulate((n for _, n in counts), initial=0))
    first = spark.createDataFrame([(r, s) for (r, _), s in zip(counts, starts, strict=False)], "__range int, __from long")
    return rows.join(F.broadcast(first), "__range").withColumn(name, F.col("__from") + F.col("__at")).drop("__range", "__at", "__from")


def with_global_index(chunks: DataFrame, doc: str, no: str) -> DataFrame:
    """Chunks with `global_index`, dense from 0 in the order of document and number."""
    return with_place(chunks, [doc, no], "global_index")


def load_once(spark: SparkSession, df: DataFrame, path: str, force: bool = False) -> bool:
    """Write df unless the target has rows; with force, replace it. Says whether it wrote."""
    if not force:
        try:
            if not spark.read.parquet(path).isEmpty():
                return False
        except Exception as gone:  # an absent target
            if "PATH_NOT_FOUND" not in str(gone) and "UNABLE_TO_INFER_SCHEMA" not in str(gone):
                raise
    df.write.mode("overwrite").parquet(path)
    return True


def reconcile(source: Mapping[str, DataFrame], target: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, source_rows, target_rows, state): counts on both sides, and whether they differ."""

    def counts(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
        out = None
        for k, df in tables.items():
            n = df.agg(F.count(F.lit(1)).alias(name)).withColumn("table_name", F.lit(k))
            out = n if out is None else out.unionByName(n)
        return out

    both = counts(source, "source_rows").join(counts(target, "target_rows"), "table_name", "full_outer")
    same = F.col("source_rows").eqNullSafe(F.col("target_rows"))
    return both.select("table_name", "source_rows", "target_rows", F.when(same, "OK").otherwise("MISMATCH").alias("state"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew where its scan has fewer partitions than there are cores, as with one small file; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
