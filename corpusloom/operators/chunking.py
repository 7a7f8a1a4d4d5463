"""Documents to chunks: recursive splitting with carried overlap, parents and children, validation and profile."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import non_empty, strip

#: Separators from coarse to fine, and sizes (size, overlap, least characters).
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ", "")
FLAT, PARENT, CHILD = (600, 150, 100), (2000, 200, 100), (200, 50, 40)


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def normalise(column: str) -> Column:
    """NFC, by Python only for texts that hold combining marks."""
    c = F.col(column)
    return F.when(c.rlike(r"\p{M}"), F.pandas_udf(_nfc, "string")(F.when(c.rlike(r"\p{M}"), c))).otherwise(c)


def _windows(pieces: list[str], joint: str, size: int, overlap: int):
    """Ranges of pieces: each is closed when the next piece would pass the size, and the tail within the overlap is carried.

    The length held counts a joint for every piece. A piece is added to the carried tail without another test, so a chunk
    can reach size + overlap + the joint.
    """
    start, held = 0, 0
    for end, piece in enumerate(pieces):
        if end > start and held + len(piece) + len(joint) > size:
            yield start, end
            while held > overlap and start < end:
                held -= len(pieces[start]) + (len(joint) if end - start > 1 else 0)
                start += 1
        elif end == start and held + len(piece) > size:
            start, held = end, 0
        held += len(piece) + len(joint)
    yield start, len(pieces)


def split_text(text: str, size: int, overlap: int, least: int) -> list[str]:
    """Chunks of a text. Pieces of at least `size` are split on with the next separator found in them."""
    if overlap < 2:
        raise ValueError("the overlap must be two characters at least")
    out: list[str] = []
    work: list[tuple[str, bool]] = [(text, False)] if text else []
    while work:
        part, whole = work.pop()
        if whole:
            out.append(part)
            continue
        joint = next((s for s in SEPARATORS if s in part), "")
        todo: list[tuple[str, bool]] = []
        small: list[str] = []

        def close(small=small, todo=todo, joint=joint):
            if small:
                chunks = (joint.join(small[a:b]).strip() for a, b in _windows(small, joint, size, overlap))
                todo.extend((c, True) for c in chunks if len(c) >= least)
                small.clear()

        for piece in part.split(joint) if joint else part:
            if len(piece) < size:
                small.append(piece)
            else:
                close()
                todo.append((piece, False))
        close()
        work.extend(reversed(todo))
    return out


def chunk(df: DataFrame, key: str, text: str, size: int = FLAT[0], overlap: int = FLAT[1], least: int = FLAT[2]) -> DataFrame:
    """(key, chunk_no, text) of every row's chunks. Null and empty texts have none."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", size, overlap, least))

    each = df.select(key, F.posexplode(F.pandas_udf(run, "array<string>")(F.col(text))).alias("chunk_no", "text"))
    return each.withColumn("char_count", F.length("text").cast("long"))


def parent_child(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, parent_no, child_no, parent_id, chunk_id, parent_text, text); a parent without a child is its own."""

    def children(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", *CHILD) or [t])

    parents = chunk(df, key, text, *PARENT).select(key, F.col("chunk_no").alias("parent_no"), F.col("text").alias("parent_text"))
    each = parents.select("*", F.posexplode(F.pandas_udf(children, "array<string>")("parent_text")).alias("child_no", "text"))
    return each.withColumn("parent_id", F.xxhash64(key, "parent_no")).withColumn("chunk_id", F.xxhash64(key, "parent_no", "child_no"))


def register_chunk_text(spark: SparkSession) -> None:
    """Make the table function chunk_text(text, size, overlap, least) known to SQL: chunk()'s (chunk_no, text) of a text, for LATERAL joins."""

    class ChunkText:
        def eval(self, text: str, size: int, overlap: int, least: int):
            yield from enumerate(split_text(text or "", size, overlap, least))

    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="chunk_no int, text string", useArrow=True))


def validate(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, reason): ok, or why a chunk is dropped."""
    reason = F.when(F.length(strip(F.col("text"))) < 100, "short").when(F.length("text") < 50, "below 50").otherwise("ok")
    return chunks.select("doc_id", "chunk_no", reason.alias("reason"))


def profile(chunks: DataFrame) -> DataFrame:
    """Parents, children, median and most children a parent, per document."""
    n = chunks.groupBy("doc_id", "parent_no").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parents"), F.sum("n").alias("children"), F.percentile("n", 0.5).alias("median_children"), F.max("n").alias("max_children"))


def normalize_subqueries(query: Column, others: Column, most: int) -> Column:
    """The query, then the distinct trimmed others, each cut to 500 characters, `most` in all."""
    alternatives = non_empty(F.transform(others, strip))
    return F.slice(F.transform(F.array_distinct(F.concat(F.array(query), alternatives)), lambda x: F.substring(x, 1, 500)), 1, most)
