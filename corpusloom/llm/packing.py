"""Sum-of-squares packing: each piece goes where the squared counts of open bins per residual gap become smallest."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import stored, table

CAPACITY = 1024
#: Pieces in a tile, the unit that is packed on the driver; a tile repeats as often as the corpus needs.
TILE = 65_536
#: Seed of the order in which a tile's pieces of at most half a sequence are placed.
SEED = 20240131


def pack_tile(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, number among its length, sequence, offset) for so many pieces of each length, and the sequences.

    Each piece goes to the gap, or to a new bin, for which the sum of the squared numbers of open bins per gap becomes
    least; of equal ones to the smallest gap. Pieces of more than half a sequence come first, from long to short, as no two
    fit together; the others follow in a fixed random order, which the rule needs to meet all lengths all along.
    """
    lengths = np.array(sorted((x for x, n in counts.items() if n), reverse=True), dtype=np.int64)
    each = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    items = np.repeat(lengths, each)
    number = np.concatenate([np.arange(n) for n in each]) if len(each) else np.empty(0, np.int64)
    short = int(np.searchsorted(-items, -(capacity // 2)))
    mixed = short + np.random.default_rng(SEED).permutation(len(items) - short)
    order = np.concatenate([np.arange(short), mixed])
    items, number = items[order], number[order]
    n = np.zeros(capacity + 1, dtype=np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    at = np.empty((len(items), 2), dtype=np.int64)
    made, never = 0, np.iinfo(np.int64).max
    for i, s in enumerate(items.tolist()):
        gap = capacity
        if s < capacity:
            here = n[s:capacity]
            change = 2 * (np.concatenate(([0], n[1 : capacity - s])) - here + 1)
            change[0] = 1 - 2 * here[0]
            change[here == 0] = never
            best = int(change.argmin())
            if change[best] <= 2 * n[capacity - s] + 1:
                gap = s + best
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = bins[gap].pop()
            n[gap] -= 1
        at[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            n[gap - s] += 1
    return np.column_stack([items, number, at]), made


def plan(counts: dict[int, int], tile: int = TILE) -> tuple[list[tuple], list[np.ndarray], int]:
    """Levels (length, level, first rank, pieces a tile, tiles, first sequence, sequences a tile), slots by level, sequences.

    A level repeats one packed tile as often as it goes into what is left; the remainders, fewer by the size of a tile each
    time, make the next level. So a corpus of any size needs a few tiles, and the driver sees lengths' counts only.
    """
    left = {x: n for x, n in counts.items() if n and 0 < x < CAPACITY}
    used: Counter = Counter()
    levels, slots, sequences = [], [], 0
    while left:
        times = -(-sum(left.values()) // tile)
        rows, made = pack_tile({x: n // times for x, n in left.items()})
        level = len(slots)
        for x, n in left.items():
            if n // times:
                levels.append((x, level, used[x], n // times, times, sequences, made))
                used[x] += n // times * times
        slots.append(rows)
        sequences += made * times
        left = {x: n % times for x, n in left.items() if n % times}
    return levels, slots, sequences


def cut(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which takes the rest."""
    first = n_ids % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n_ids, capacity))]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, local long"


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents' pieces with the CRC of their ids, stored: tokenizing happens once. Ranks of equal lengths are per task."""
    path = path or tokens.default_path()

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = [*tokens.encode(text, path), tokens.EOS]
                raw = tokens.packed(ids)
                for k, (start, length) in enumerate(cut(len(ids))):
                    rows.append((doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], [c.split()[0] for c in _PIECE.split(", ")])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECE)
    return stored(found.withColumn("task", F.shiftright(F.monotonically_increasing_id(), 33)))


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the single id that ends a document. Repeated rows are packed each; a null doc_id stays null;
    columns beside doc_id and text aren't read, whatever their names; texts of any length are cut, never shortened; an
    empty table gives no rows.
    """
    found = pieces(docs, path)
    spark = docs.sparkSession
    by_task = found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # CAPACITY rows at most
    levels, slots, sequences = plan(counts)
    ranked = found.join(first, ["length", "task"]).withColumn("rank", F.col("local") + F.col("from")).drop("local", "from", "task")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = ranked.where(F.col("length") == CAPACITY).withColumn("sequence_id", F.col("rank") + sequences).withColumn("offset", F.lit(0).cast("long"))
    if not slots:
        return full.select(out)
    level_rows = spark.createDataFrame(levels, "length long, level int, first long, each long, times long, base long, made long")
    flat = np.concatenate([np.column_stack([np.full(len(s), k), s]) for k, s in enumerate(slots)])
    slot_rows = spark.createDataFrame(pa.table({name: pa.array(flat[:, k], pa.int64()) for k, name in enumerate(("level", "length", "number", "sequence", "offset"))}))
    rank = F.col("rank") - F.col("first")
    # CAPACITY rows a level, and TILE rows a level, bound both broadcasts
    placed = (
        ranked.where(F.col("length") < CAPACITY)
        .join(F.broadcast(level_rows), "length")
        .where((rank >= 0) & (rank < F.col("each") * F.col("times")))
        .withColumn("number", rank % F.col("each"))
        .withColumn("tile", F.floor(rank / F.col("each")))
        .join(F.broadcast(slot_rows), ["level", "length", "number"])
        .withColumn("sequence_id", F.col("base") + F.col("tile") * F.col("made") + F.col("sequence"))
    )
    return placed.select(out).unionByName(full.select(out))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents; its docstring says what nulls, empty texts, repeated rows and empty tables give."""
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline's last stage: where each piece of each document lies."""
    return pack(docs)
