"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, stored, table

SHARDS, RACKS_PER_REGION, SHARDS_PER_RACK = 16, 2, 4
#: Rows that are ranked in one task when slots are given, on average.
UNIT_ROWS = 65_536


def tree(shards: int, racks_per_region: int = RACKS_PER_REGION, shards_per_rack: int = SHARDS_PER_RACK) -> list[list[list[int]]]:
    """Regions, their racks, and the racks' shards, filled in the order of the shard numbers."""
    racks = [list(range(a, min(a + shards_per_rack, shards))) for a in range(0, shards, shards_per_rack)]
    return [racks[a : a + racks_per_region] for a in range(0, len(racks), racks_per_region)]


def _draw(key: Column, level: str, at: int, weight: float) -> Column:
    """An exponential variable of the node's rate: -ln(u) / weight with u in (0, 1) from the key, the node's level and its number."""
    u = (F.pmod(F.xxhash64(F.lit(level), F.lit(at), key), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(float(weight))


def _choose(key: Column, level: str, nodes: list[tuple[int, float]]) -> Column:
    """The number of the node (number, weight) with the least draw, the first of equal ones."""
    draws = [F.struct(_draw(key, level, at, weight).alias("draw"), F.lit(at).alias("at")) for at, weight in nodes if weight > 0]
    return F.lit(nodes[0][0]) if len(nodes) == 1 else (F.least(*draws)["at"] if len(draws) > 1 else draws[0]["at"])


def _below(chosen: Column, choices: dict[int, Column]) -> Column:
    """The choice that belongs to the chosen node; only that one is computed for a row."""
    first, *rest = choices.items()
    out = F.when(chosen == first[0], first[1])
    for at, choice in rest:
        out = out.when(chosen == at, choice)
    return out


def assign(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", weights: dict[int, float] | None = None, to: str = "shard", racks_per_region: int = RACKS_PER_REGION, shards_per_rack: int = SHARDS_PER_RACK) -> DataFrame:
    """Add the shard of each row as column `to` (an existing one is replaced).

    Every region, rack and shard has a weighted draw of its own, by the key, its level and its number; a node weighs what
    its shards weigh together. A row goes to the region with the least draw, there to the rack with the least, there to
    the shard. So a row costs as many draws as there are nodes beside its path, not one for each shard, and when a weight
    changes, only draws on the path to it change: rows move into, or out of, the changed region alone; inside it into,
    or out of, the changed rack alone; and rows that stay elsewhere keep their racks and shards. A shard that forms a
    new region only takes rows into itself. Shards of weight 0 get nothing; one at least must weigh more.

    Null keys hash like any value and share one shard; repeated keys land together; an empty table stays empty; other columns
    stay, whatever their names. From 16 to 17 shards the new one is a region of its own; from 17 to 18 that region's weight rises, and
    rows enter shard 16 as well, so law `key` holds where a shard is added as a new region.
    """
    weight = lambda s: (weights or {}).get(s, 1.0)
    regions = tree(shards, racks_per_region, shards_per_rack)
    heavy = lambda nodes: sum(weight(s) for s in nodes)
    racks = {r: {rack[0] // shards_per_rack: rack for rack in region if heavy(rack) > 0} for r, region in enumerate(regions)}
    racks = {r: inside for r, inside in racks.items() if inside}
    k, at_region, at_rack = F.col(key), fresh(df, "__region"), fresh(df, "__rack")
    region = _choose(k, "region", [(r, sum(map(heavy, inside.values()))) for r, inside in racks.items()])
    rack = _below(F.col(at_region), {r: _choose(k, "rack", [(n, heavy(rack)) for n, rack in inside.items()]) for r, inside in racks.items()})
    leaves = {n: [(s, weight(s)) for s in rack if weight(s) > 0] for inside in racks.values() for n, rack in inside.items()}
    shard = _below(F.col(at_rack), {n: _choose(k, "shard", found) for n, found in leaves.items()})
    placed = df.withColumn(at_region, region).withColumn(at_rack, rack).withColumn(to, shard.cast("int"))
    return placed.drop(at_region, at_rack)


def number(df: DataFrame, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Add `slot`, gapless from 0 in each shard, without ranking a whole shard in one task, whatever its keys.

    The rows are written once with a number of their own, whose hash deals each shard into units; the units' counts give
    offsets, and rows are ranked inside their unit. A key that many rows repeat is dealt like any others. A column `slot` is
    replaced; all others stay, whatever their names.
    """
    row, unit, n, start, rank = (fresh(df, name) for name in ("__row", "__unit", "__n", "__from", "__rank"))
    kept = stored(df.withColumn(row, F.monotonically_increasing_id()))
    units = max(1, -(-kept.count() // unit_rows))
    kept = kept.withColumn(unit, F.pmod(F.xxhash64(row), F.lit(units)))
    sizes = kept.groupBy("shard", unit).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy("shard").orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", unit, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    ranked = kept.withColumn(rank, F.row_number().over(Window.partitionBy("shard", unit).orderBy(row)) - 1)
    return ranked.join(offsets, ["shard", unit]).withColumn("slot", (F.col(start) + F.col(rank)).cast("long")).drop(row, unit, rank, start)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard under law `key`, its slot there, and its shard when a 17th is added, which is a region of its own.

    A null text counts as empty: size 1, CRC 0. Null ids share a shard, repeated rows take a slot each, and texts of any
    length count whole; other columns aren't read; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = assign(assign(rows), SHARDS + 1, to="grown_shard")
    return number(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
