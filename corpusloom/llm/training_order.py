"""Training-order materialisation: a keyed Feistel permutation gives every sequence a global slot; ranges of slots are shards of fixed stride."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import shared_dir, stored, table

#: Tokens of a sequence, records of a shard, and tasks that write shards at most. A record is doc_id, seq, n_tokens, then the ids, padded.
LENGTH, PER_SHARD, TASKS = 1024, 16_384, 65_536
HEADER = 16
STRIDE = HEADER + 2 * LENGTH


def record(width: int = 2) -> np.dtype:
    """A record with ids of `width` bytes, little-endian; vocabularies beyond 65,536 ids take 4."""
    return np.dtype([("doc_id", "<i8"), ("seq", "<i4"), ("n_tokens", "<u4"), ("ids", f"<u{width}", (LENGTH,))])


#: Set in a record's n_tokens where doc_id is null.
NO_ID = 1 << 31
KEY, ROUNDS = 20240131, 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(at: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of the places `at` under a keyed permutation of 0..n-1.

    A balanced Feistel network permutes the next even power of two; a value beyond n is sent through again until it falls
    inside, which keeps it a permutation of 0..n-1 and takes fewer than four rounds on average.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right + np.uint64((key * 2 + 1 + (r << 40)) % (1 << 64))) & mask)
        out[todo] = x = (left << half) | right
        todo = todo[x >= n]
    return out.astype(np.int64)


_ROW = "doc_id long, seq int, n_tokens int, ids binary"


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Each document's ids with the end id, cut into sequences of `length` (the last may be shorter), as little-endian ids of tokens.width() bytes."""
    path = path or tokens.default_path()
    kind = f"<u{tokens.width(path)}"

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.array([*tokens.encode(text, path), tokens.EOS], dtype=kind)
                rows += [(doc_id, k // length, len(part := raw[k : k + length]), part.tobytes()) for k in range(0, len(raw), length)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _ROW.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROW)


def _by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """Rows dealt to one partition a shard, or to TASKS of them with a range of shards each."""
    parts = min(shards, TASKS)
    return rows.repartitionById(parts, F.floor(F.col("shard").cast("long") * parts / shards).cast("int"))


def training_order(docs: DataFrame, path: str | None = None, key: int = KEY, per_shard: int = PER_SHARD) -> DataFrame:
    """Per sequence: slot, shard, record, doc_id, seq, n_tokens, ids; a shard lies in one partition, in the order of slots.

    The sequences are stored once with a place (task, number in the task). Counts per task make places gapless, the
    permutation of 0..n-1 makes them slots. Slots are uniform, so shards are equal ranges and need no sampling pass. Null and
    empty texts are one sequence of the end id; repeated rows are separate sequences; an empty table gives no rows.
    """
    rows = sequences(docs, path).withColumn("place", F.monotonically_increasing_id())
    kept = stored(rows, "zstd")
    task = F.shiftright("place", 33)
    sizes = kept.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()  # a row for each task
    starts, n = {}, 0
    for r in sizes:
        starts[r["task"]], n = n, n + r["n"]
    shards = max(1, -(-n // per_shard))

    def run(batches):
        for batch in batches:
            place = batch.column("place").to_numpy()
            base = np.array([starts[t] for t in (place >> 33).tolist()], dtype=np.int64)
            slot = permute(base + (place & ((1 << 33) - 1)), n, key)
            yield batch.drop_columns(["place"]).append_column("slot", pa.array(slot))

    placed = kept.mapInArrow(run, f"{_ROW}, slot long")
    placed = placed.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int")).withColumn("record", (F.col("slot") % per_shard).cast("int"))
    return _by_shard(placed, shards).sortWithinPartitions("slot").select("slot", "shard", "record", "doc_id", "seq", "n_tokens", "ids")


def _records(batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    doc_id, ids = batch.column("doc_id"), batch.column("ids")
    n_tokens = batch.column("n_tokens").to_numpy()
    out = np.zeros(batch.num_rows, kind)
    out["doc_id"], out["seq"] = doc_id.fill_null(0).to_numpy(), batch.column("seq").to_numpy()
    out["n_tokens"] = n_tokens + NO_ID * doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    out["ids"][np.arange(LENGTH) < n_tokens[:, None]] = np.frombuffer(b"".join(ids.to_pylist()), kind["ids"].base)
    return out


_BLOCK = "shard int, first_slot long, n int, width int, crc32 long, payload binary"
_MANIFEST = "_manifest"


def write_shards(ordered: DataFrame, path: str, block: int = 1024, width: int = 2) -> None:
    """Write blocks of records of one stride, HEADER + width * LENGTH bytes, in slot order, each shard by one task; then the manifest.

    A block is a row (shard, first_slot, n, width, crc32 of the payload, payload). A record lies at (slot - first_slot) * stride in
    its block's payload, so a reader starts again at any slot. The manifest, JSON in the folder `_manifest`, tells each shard's
    first slot, records and checksum of its blocks' checksums; it is written last, so a folder that has it is whole.
    """
    kind = record(width)

    def run(batches):
        shard, first, parts, count = None, None, [], 0

        def flush():
            payload = b"".join(parts)
            values = (shard, first, count, width, zlib.crc32(payload), payload)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            shards, slots, at = batch.column("shard").to_numpy(), batch.column("slot").to_numpy(), 0
            while at < len(shards):
                if count and (shards[at] != shard or count == block):
                    yield flush()
                    parts, count = [], 0
                if not count:
                    shard, first = int(shards[at]), int(slots[at])
                rest = shards[at : at + block - count]
                other = np.flatnonzero(rest != shard)
                m = int(other[0]) if len(other) else len(rest)
                parts.append(_records(batch.slice(at, m), kind).tobytes())
                count, at = count + m, at + m
        if count:
            yield flush()

    ordered.mapInArrow(run, _BLOCK).write.mode("overwrite").option("compression", "zstd").parquet(path)
    sums = F.crc32(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("first_slot", "crc32"))), lambda b: b["crc32"].cast("string"))))
    each = ordered.sparkSession.read.schema(_BLOCK).parquet(path).groupBy("shard").agg(F.min("first_slot").alias("first_slot"), F.sum("n").alias("records"), F.first("width").alias("width"), sums.alias("checksum"))
    each.write.mode("overwrite").json(f"{path}/{_MANIFEST}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, first_slot, records, width, checksum) of written shards."""
    return spark.read.schema("shard int, first_slot long, records long, width int, checksum long").json(f"{path}/{_MANIFEST}")


def read_shards(blocks: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """The records in blocks of slots start..stop-1 (all without stop): slot, shard, doc_id, seq, n_tokens, ids, in no order of blocks.

    A block whose payload doesn't give its checksum fails the job.
    """

    def run(batches):
        for batch in batches:
            for shard, first, n, width, crc, payload in zip(*(batch.column(c.split()[0]) for c in _BLOCK.split(", ")), strict=True):
                shard, first, n, width = shard.as_py(), first.as_py(), n.as_py(), width.as_py()
                a, b = max(0, start - first), n if stop is None else min(n, stop - first)
                if a >= b:
                    continue
                if zlib.crc32(payload.as_buffer()) != crc.as_py():
                    raise ValueError(f"shard {shard}: the block of slot {first} is damaged")
                r = np.frombuffer(payload.as_buffer(), record(width), n)[a:b]
                null, m = r["n_tokens"] >= NO_ID, (r["n_tokens"] & (NO_ID - 1)).astype(np.int32)
                flat = r["ids"][np.arange(LENGTH) < m[:, None]].tobytes()
                offsets = np.concatenate([[0], np.cumsum(width * m)]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)])
                columns = {"slot": pa.array(np.arange(first + a, first + b), pa.int64()), "shard": pa.array(np.full(len(m), shard), pa.int32())}
                columns |= {"doc_id": pa.array(r["doc_id"].copy(), pa.int64(), mask=null), "seq": pa.array(r["seq"].copy(), pa.int32())}
                yield pa.RecordBatch.from_pydict(columns | {"n_tokens": pa.array(m, pa.int32()), "ids": ids})

    return blocks.mapInArrow(run, f"slot long, shard int, {_ROW}")


def read_slots(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Slots start..stop-1 of written shards, in order: slot, doc_id, seq, n_tokens, ids. Blocks outside are pruned by first_slot."""
    blocks = spark.read.schema(_BLOCK).parquet(path).where((F.col("first_slot") < stop) & (F.col("first_slot") + F.col("n") > start))
    return read_shards(blocks, start, stop).drop("shard").orderBy("slot")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of all documents as its record in the written shards holds it, with the CRC-32 of its ids as stored.

    The shards are written under the shared folder and read back, a shard in one partition, in the order of slots. Null and empty
    texts are one sequence of the end id; null ids stay null; repeated rows are separate sequences; long texts are cut into
    as many as they need; other columns aren't read; an empty table gives no rows.
    """
    path = f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
    write_shards(training_order(table(spark, sf_dir, "documents")), path, width=tokens.width(tokens.default_path()))
    last = manifest(spark, path).agg(F.max("shard")).first()[0]
    at = (F.col("slot") - F.col("shard").cast("long") * PER_SHARD).cast("int").alias("record")
    rows = read_shards(spark.read.schema(_BLOCK).parquet(path)).select("slot", "shard", at, "doc_id", "seq", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return _by_shard(rows, (last or 0) + 1).sortWithinPartitions("slot")
