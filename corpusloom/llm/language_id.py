"""Language by compression: the language whose zstandard raw-content dictionary makes a text smallest."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import per_batch, table

#: Bounds of what is learned: texts a language, characters of one, bytes a language, and bytes of all languages, which
#: shrink every language's share where there are many. The last bounds the driver.
TEXTS, TEXT_CHARS, DICTIONARY_BYTES, ALL_BYTES = 256, 2048, 1 << 17, 1 << 26
#: Texts are encoded in blocks, so that the dictionary counts all along a long text.
BLOCK_BYTES = 4096
#: A fast level leaves literals as they are, so a size shows what the dictionary matched; held-out accuracy was best with it.
LEVEL = -1
#: A prediction whose best size is less than this share under the second is marked as rejected.
MARGIN = 0.01


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary per language of labelled rows that aren't held out.

    The sample: of each language at most TEXTS rows, those with the smallest id hashes; of a longer text the TEXT_CHARS that
    begin at a place its hash chooses; as many of these as fill the language's share of bytes. No language is left out.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    spare = F.greatest(F.length("text") - TEXT_CHARS, F.lit(0))
    part = F.substring("text", F.pmod(F.xxhash64("doc_id", F.length("text")), (spare + 1).cast("long")).cast("int") + 1, F.lit(TEXT_CHARS)).alias("text")
    first = rows.select("lang", "doc_id", part).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= TEXTS)
    filled = Window.partitionBy("lang").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("__before", F.coalesce(F.sum(F.octet_length("text")).over(filled), F.lit(0)))
    languages = max(1, rows.select("lang").distinct().count())
    share = min(DICTIONARY_BYTES, ALL_BYTES // languages)
    found: dict[str, list[bytes]] = {}
    for r in first.where(F.col("__before") < share).orderBy("lang", "__n").toLocalIterator():
        found.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "replace"))
    return {lang: b"\n".join(texts)[:share] for lang, texts in found.items()}


class Classifier:
    """Per-task encoders with the dictionaries attached once."""

    def __init__(self, learned: dict[str, bytes]):
        self.names = sorted(learned)
        self.encoders = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); score is the best size's distance to the second, as a share."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = text.encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        sizes = sorted((sum(len(e.compress(b)) for b in blocks), i) for i, e in enumerate(self.encoders))
        score = 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]
        return self.names[sizes[0][1]], score, score < MARGIN


def identify(docs: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, rejected (a narrow margin; the best guess still stands).

    Null texts, texts without a letter, and all texts where nothing was learned are `und` with score 0. Ties go to the
    first language by name; repeated rows repeat; long texts are encoded whole, in blocks; an empty table gives no rows;
    columns beside doc_id and text aren't read, whatever their names.
    """

    def run(batches):
        model = Classifier(learned)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

        return per_batch(one)(batches)

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out; learn() and identify() say what awkward rows give."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
