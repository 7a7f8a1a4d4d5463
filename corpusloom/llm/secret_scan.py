"""Multipart credential linking: base matches stand alone; weak candidates count only beside complementary parts in their scope."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .common import maybe_broadcast, per_batch, stored, table

#: The base patterns and the kinds' order in span lists; the last three kinds are the method's.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "access_id", "secret", "endpoint")

#: Weak parts: identifiers of capitals and digits, mixed high-entropy strings, and addresses.
WEAK_ID = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Z0-9]{16,}(?![A-Za-z0-9+/_=-])")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:amazonaws\.com|internal|local)\b", re.ASCII)
MIN_BITS = 3.0
#: Code points between two parts of one credential at most.
SCOPE = 200

_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _bits(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _clear_of(spans: list[tuple[int, int]]):
    """A test that a match overlaps none of the spans, by binary search in their union."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    ends = [end for _, end in merged]

    def clear(m: re.Match) -> bool:
        i = bisect_right(ends, m.start())
        return i == len(merged) or merged[i][0] >= m.end()

    return clear


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of weak parts that overlap no base span and no part before them in this order, in order."""
    mixed = lambda s: any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    taken = [(a, b) for a, _, b in base]
    found = []
    for kind, pattern, fits in (
        (5, ENDPOINT, lambda s: True),
        (3, WEAK_ID, mixed),
        (4, WEAK_SECRET, lambda s: mixed(s) and _bits(s) >= MIN_BITS),
    ):
        clear = _clear_of(taken)
        new = [(m.start(), kind, m.end()) for m in pattern.finditer(text) if fits(m[0]) and clear(m)]
        taken += [(a, b) for a, _, b in new]
        found += new
    return sorted(found)


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    bases, weaks = [], []
    for text in batch.column("text").to_pylist():
        base = base_spans(text) if text else []
        weak = weak_spans(text, base) if text else []
        # a weak part needs company: alone in its text it is never reported
        weaks.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in weak] if len(base) + len(weak) > 1 else [])
        bases.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in base])
    return batch.append_column("base", pa.array(bases, pa.list_(_SPAN))).append_column("weak", pa.array(weaks, pa.list_(_SPAN)))


def scan(df: DataFrame, keep_text: bool) -> DataFrame:
    """row (a unique number), rest (a struct of df's columns but text, so that no names clash), text if kept, base, weak.

    Written once, so that row stays the same for all who read it.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"])
    rows = df.select(F.monotonically_increasing_id().alias("row"), rest.alias("rest"), F.col("text").cast("string").alias("text"))
    new = DataType.fromDDL(f"base {_SPANS}, weak {_SPANS}")
    found = rows.mapInArrow(per_batch(_scan), StructType([*rows.schema.fields, *new.fields]))
    return stored(found if keep_text else found.drop("text"))


def link(scanned: DataFrame) -> DataFrame:
    """(row, added): the weak parts with enough company.

    An interval join on (row, cell of SCOPE code points) finds the parts within SCOPE of each weak one; a cell holds few
    parts, so their number per weak part is bounded. A weak identifier or secret needs a base match of the opposite
    role, or a weak one and an endpoint; an endpoint needs both roles.
    """
    cell = F.floor(F.col("s.start") / SCOPE)
    weak = scanned.where(F.size("weak") > 0).select("row", F.explode("weak").alias("s")).withColumn("cell", cell)
    parts = scanned.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("p"))
    spread = parts.select("row", "p", F.explode(F.sequence(F.floor((F.col("p.start") - SCOPE) / SCOPE) - 1, F.floor((F.col("p.end") + SCOPE) / SCOPE))).alias("cell"))
    near = weak.join(spread, ["row", "cell"]).where((F.col("p.start") <= F.col("s.end") + SCOPE) & (F.col("s.start") <= F.col("p.end") + SCOPE))
    k = F.col("p.kind")
    some = lambda *kinds: F.bool_or(k.isin(*kinds))
    company = near.groupBy("row", "s").agg(some(1).alias("a"), some(3).alias("a_weak"), some(0, 2).alias("b"), some(4).alias("b_weak"), some(5).alias("e"))
    kind = F.col("s.kind")
    enough = (
        F.when(kind == 3, F.col("b") | (F.col("b_weak") & F.col("e")))
        .when(kind == 4, F.col("a") | (F.col("a_weak") & F.col("e")))
        .otherwise((F.col("a") | F.col("a_weak")) & (F.col("b") | F.col("b_weak")))
    )
    return company.where(enough).groupBy("row").agg(F.collect_list("s").alias("added"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row of df: rest (a struct of its columns but text), text if kept, base and spans (arrays of (start, kind, end), code points).

    spans holds the base spans and the linked ones. Null and empty texts have none; texts are read whole, whatever their length;
    repeated rows each get their own result; an empty table gives no rows; df's other columns may have any names.
    """
    scanned = scan(df, keep_text)
    added = stored(link(scanned))
    spans = added.agg(F.sum(F.size("added"))).first()[0] or 0
    joined = scanned.join(maybe_broadcast(added, spans, 40), "row", "left")
    return joined.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS))))).drop("added", "weak", "row")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of all documents; find_secrets() says what nulls, empty and long texts and repeated rows give."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    doc_id = F.col("rest")["doc_id"].alias("doc_id")
    return found.select(doc_id, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact_text(text: str, spans: list[tuple[int, int]], mask: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact(batch: pa.RecordBatch) -> pa.RecordBatch:
    spans = [[(s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
    texts = [redact_text(t, s) for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
    return batch.drop_columns(["spans"]).set_column(batch.schema.names.index("text"), "text", pa.array(texts, pa.string()))


def redact(df: DataFrame) -> DataFrame:
    """df with secrets masked in text; n_chars, if there, follows the new text. find_secrets() says what awkward rows give."""
    found = find_secrets(df, keep_text=True).select("rest", "text", "spans")
    clean = found.where(F.size("spans") == 0).drop("spans")
    masked = found.where(F.size("spans") > 0).mapInArrow(per_batch(_redact), clean.schema)

    def column(c: str, new: bool) -> Column:
        if c == "text" or (c == "n_chars" and new):
            return (F.col("text") if c == "text" else F.length("text")).cast(df.schema[c].dataType).alias(c)
        return F.col("rest")[c].alias(c)

    return clean.select([column(c, False) for c in df.columns]).unionByName(masked.select([column(c, True) for c in df.columns]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every document stays, with its secrets masked."""
    return redact(docs)
