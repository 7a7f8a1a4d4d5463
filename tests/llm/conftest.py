import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
#: Nulls, empty, blank and very long texts, ties, repeated rows.
EDGE = [
    (1, "", "en", "s", 0),
    (2, None, None, None, None),
    (3, " \t\n", "en", "s", 3),
    (4, "one two three", "en", "s", 13),
    (5, "one two three", "en", "s", 13),
    (6, LONG, "en", "s", len(LONG)),
    (7, "one two three", None, "s", 13),
    (7, "one two three", None, "s", 13),
    (None, "no id at all here", "de", "s", 17),
    (8, "über straße größe ñandú", "de", None, 23),
    (9, "😀 日本 текст", "de", "s", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """The awkward rows, with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGE, SCHEMA).withColumn("component", F.lit("x")).withColumn("shard", F.lit("y")).withColumn("rank", F.lit(1))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, sf):
    """(doc_id, text, lang) of the smallest table, in Python."""
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
