"""MinHash near-duplicates: universal hash minima in bands, links confirmed on full sets, components by alternating large-star and small-star."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import checkpoint, maybe_broadcast, on_task, per_batch, stored, stored_by_task, table
from .words import SHINGLE, shingles

#: 32 bands of 4 minima: a pair of similarity 0.75 misses every band with probability 5e-6.
BANDS, ROWS = 32, 4
#: 100 * intersection >= PERCENT * union makes a link.
PERCENT = 75
#: Members that a hub's text is sent out for once, so that a large group is compared by many tasks.
CHUNK = 1024
#: Outer members of a group that all others are compared with at once, where all they share may lie in the hub.
PIVOTS = 64

_rng = np.random.default_rng(20240131)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_BAND_MUL = np.array([xxhash.xxh3_64_intdigest(b"row%d" % i) | 1 for i in range(ROWS)], dtype=np.uint64)
_BAND_ADD = np.array([xxhash.xxh3_64_intdigest(b"band%d" % i) for i in range(BANDS)], dtype=np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each of the BANDS * ROWS functions over a shingle set.

    A function takes the upper 32 bits of a shingle's hash to the upper 32 bits of a*x+b mod 2^64, with random 64-bit a and
    b: multiply-add-shift, a 2-universal family. The least 64-bit value has the least upper half, so it is shifted last.
    """
    x = found >> np.uint64(32)
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(x), 1024):
        v = x[i : i + 1024, None] * _A
        v += _B
        np.minimum(out, v.min(axis=0), out=out)
    return out >> np.uint64(32)


def band_keys(m: np.ndarray) -> np.ndarray:
    h = (m.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_MUL).sum(axis=1, dtype=np.uint64) + _BAND_ADD
    h ^= h >> np.uint64(32)
    h *= _BAND_MUL[0]
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, keys, bands = [], [], []
    for text in batch.column("text"):
        s = shingles(text.as_py())
        sizes.append(len(s))
        keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
        bands.append(band_keys(minima(s)) if len(s) else None)
    for name, values in (("n_shingles", pa.array(sizes, pa.int64())), ("set_key", pa.array(keys, pa.binary())), ("bands", pa.array(bands, pa.list_(pa.int64())))):
        batch = batch.append_column(name, values)
    return batch


def signatures(docs: DataFrame, whole: bool = False) -> DataFrame:
    """One row per document: row (a unique number), doc_id, text, n_shingles, set_key (128-bit digest of the shingle set), bands (64-bit keys).

    With whole, also a struct `rest` of all columns but text, which keeps their names apart from these. The table is written
    once, so the numbers stay the same for all who read it, with the writing task as bucket, so that its texts needn't move.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")] if whole else []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    new = [StructField("n_shingles", LongType()), StructField("set_key", BinaryType()), StructField("bands", ArrayType(LongType()))]
    return stored_by_task(rows.mapInArrow(per_batch(_sign), StructType([*rows.schema.fields, *new])))


def _compare(with_rest: bool):
    """Members against their hub, whose row comes before theirs: the sizes, what is common, and what the hub lacks of a member."""

    def run(batches):
        key, hub = None, np.empty(0, np.uint64)
        for batch in batches:
            rows = []
            for h, chunk, kind, rep, text in zip(*batch.columns, strict=True):
                found = shingles(text.as_py())
                if not kind.as_py():
                    key, hub = (h, chunk), found
                    continue
                assert key == (h, chunk), "a hub's row is missing"
                at = np.minimum(np.searchsorted(hub, found), len(hub) - 1)
                held = hub[at] == found
                n = int(held.sum())
                linked = 100 * n >= PERCENT * (len(hub) + len(found) - n)
                rows.append((h.as_py(), rep.as_py(), len(found), n, linked, found[~held].view(np.int64) if with_rest else None))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["hub", "rep", "size", "common", "linked", "beyond"])

    return run


def compare(pairs: DataFrame, texts: DataFrame, with_rest: bool = False) -> DataFrame:
    """Pairs (hub, rep) with the rep's size, what is common, whether they are similar enough, and the shingles beyond the hub.

    A hub's text is sent once for CHUNK of its members, not once a pair, and its members stream past it, so no group is held.
    texts: row, text.
    """
    # a table of its own, so that Spark can split the other side of the join where one hub has many rows
    many = stored(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    members = pairs.join(many, "hub").select("hub", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("kind"), "rep")
    hubs = many.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), F.col("hub").alias("rep"))
    told = members.unionByName(hubs).join(texts.withColumnRenamed("row", "rep"), "rep").select("hub", "chunk", "kind", "rep", "text")
    dealt = told.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "kind", "rep")
    return dealt.mapInArrow(_compare(with_rest), "hub long, rep long, size long, common long, linked boolean, beyond array<long>")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): alternate large-star and small-star until nothing changes.

    Only minima are gathered per node, with partial aggregation, so a node with very many neighbours splits like any
    skewed join. The edges are checkpointed after each round.
    """
    now = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        now = checkpoint(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = new


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (rep, component) with components merged along links (hub, rep) between members."""
    of = [labels.select(F.col("rep").alias(x), F.col("component").alias(c)) for x, c in (("hub", "a"), ("rep", "b"))]
    merged = connected_components(links.select("hub", "rep").join(of[0], "hub").join(of[1], "rep").select("a", "b"))
    return checkpoint(labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("rep", F.coalesce("to", "component").alias("component")))


def _may_pass(common: Column, size: Column, other: Column) -> Column:
    """Sets of these sizes that have at most `common` shingles in common may still be similar enough."""
    return 100 * common >= PERCENT * (size + other - common)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("hub"), F.greatest(x, y).alias("rep")]


def _other(members: DataFrame, *names: str) -> DataFrame:
    """The same members as the other side of a join on `names`, behind o_."""
    return members.select(*names, *[F.col(c).alias(f"o_{c}") for c in members.columns if c not in names])


def _sharing_beyond(members: DataFrame) -> DataFrame:
    """Pairs (hub, rep) of different components that may be similar and share a shingle which their hub lacks.

    An outer member shares at most `common` shingles with anyone inside the hub, so it needs 3/4 of its size less that many
    beyond it: its rarest shingles there, all but need - 1 of them, meet every partner. Shingles that no other component
    holds count as absent.
    """
    each = members.select("hub", "rep", "size", "common", "component", "outer", F.explode("beyond").alias("shingle"))
    often = each.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("hub", "shingle", "often")
    by_member = Window.partitionBy("hub", "rep")
    held = each.join(often, ["hub", "shingle"]).withColumn("place", F.row_number().over(by_member.orderBy("often", "shingle"))).withColumn("extra", F.count(F.lit(1)).over(by_member))
    held = stored(held.drop("often"))
    need = F.ceil(PERCENT * F.col("size") / 100) - F.col("common")
    outer = held.where(F.col("outer") & (F.col("place") <= F.col("extra") - F.greatest(need, F.lit(1)) + 1))
    other = _other(held.select("hub", "shingle", "rep", "size", "common", "component", "extra"), "hub", "shingle")
    fits = _may_pass(F.least("common", "o_common") + F.least("extra", "o_extra"), F.col("size"), F.col("o_size"))
    apart = F.col("component") != F.col("o_component")
    return outer.join(other, (outer["hub"] == other["hub"]) & (outer["shingle"] == other["shingle"]) & apart & fits).select(*_pair("rep", "o_rep")).distinct()


def _inside(members: DataFrame) -> DataFrame:
    """Members whom what they share with the hub may suffice for, with the cells of their intervals.

    Two of them may pass by the hub's shingles alone when size + other size <= 7/3 of the smaller `common`, that is, when
    their intervals [size, 7/3 common - size] overlap. Cells grow by 4/3, as no interval is longer, so one lies in two at most.
    """
    reach = (100 + PERCENT) * F.col("common") / PERCENT - F.col("size")
    cell = lambda x: F.floor(F.log(x) / F.log(F.lit(100 / PERCENT)) + 1e-9)
    wide = members.where(reach >= F.col("size"))
    return wide.select("hub", "rep", "size", "common", "outer", F.explode(F.sequence(cell(F.col("size")), cell(reach * (1 + 1e-9)))).alias("cell"))


def link_classes(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(rep, component) of the classes of equal sets that share a bucket with another class. classes: rep, bands; rows: row, text.

    Work in a bucket never takes all pairs of similar texts, and no link is lost. First each member is compared with the
    bucket's hub, the member with the most company over all its buckets, and links make components. Only where a hub has
    members outside its component do pairs remain. Two such members either share a shingle that the hub lacks, and an equal
    join on those finds them; or all they share lies in the hub, and a join on intervals of sizes finds them. That join takes
    PIVOTS outer members of a group at a time, a growing number, so that those who find a link needn't go on.
    """
    each = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = checkpoint(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = stored(each.join(maybe_broadcast(shared, shared.count(), 16), "bucket"))
    company = checkpoint(members.groupBy("rep").agg(F.sum("n").alias("company")))
    known = company.count()
    texts = stored(rows.select("task", "row", "text").join(on_task(company.select(F.col("rep").alias("row")), "row"), ["task", "row"], "left_semi").select("row", "text"))
    hubs = stored(members.join(maybe_broadcast(company, known, 16), "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("company", -F.col("rep"))).alias("hub")))
    with_hub = members.join(hubs, "bucket").where("rep <> hub").select("hub", "rep").distinct()
    done = stored(compare(checkpoint(with_hub), texts, with_rest=True))
    own = company.select("rep", F.col("rep").alias("component"))
    labels = _relabel(own, done.where("linked"))

    def labelled(labels: DataFrame) -> DataFrame:
        at = done.join(labels, "rep").join(labels.select(F.col("rep").alias("hub"), F.col("component").alias("hub_component")), "hub")
        at = stored(at.withColumn("outer", F.col("component") != F.col("hub_component")))
        opened = at.groupBy("hub").agg(F.bool_or("outer").alias("open"), F.count(F.lit(1)).alias("n")).where("open and n > 1").select("hub")
        return at.join(stored(opened), "hub")

    seen = done.select(*_pair("hub", "rep"))
    left = stored(labelled(labels))
    inside = checkpoint(_inside(left))
    found = _sharing_beyond(left)
    share = PIVOTS
    while True:
        at = inside.join(labels, "rep")
        outside = at.where("outer").groupBy("hub", "cell").agg(F.count(F.lit(1)).alias("outside"))
        draw = F.pmod(F.xxhash64("rep", F.lit(share)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        pivots = _other(at.where("outer").join(outside, ["hub", "cell"]).where(draw * F.col("outside") < share).select("hub", "cell", "rep", "size", "common", "component"), "hub", "cell")
        fits = _may_pass(F.least("common", "o_common"), F.col("size"), F.col("o_size"))
        apart = F.col("component") != F.col("o_component")
        met = at.join(pivots, (at["hub"] == pivots["hub"]) & (at["cell"] == pivots["cell"]) & apart & fits).select(*_pair("rep", "o_rep"))
        pairs = checkpoint((met if found is None else met.unionByName(found)).distinct().join(seen, ["hub", "rep"], "left_anti"))
        compared = checkpoint(compare(pairs, texts).select("hub", "rep", "linked"))
        if not compared.where("linked").isEmpty():
            labels = _relabel(labels, compared.where("linked"))
        crowded = outside.where(F.col("outside") > share).select("hub", "cell")
        inside = checkpoint(inside.join(crowded, ["hub", "cell"]))
        if inside.isEmpty():
            return labels
        seen, found, share = seen.unionByName(pairs), None, 4 * share


def _classes(sig: DataFrame) -> tuple[DataFrame, int]:
    """(set_key, to_id, to_row) of the classes with company, and their number: the first row of the class's component and its doc_id."""
    # the first row of a class or component has its smallest doc_id, and those without one come last
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = sig.where("n_shingles > 0").groupBy("set_key").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("rep", F.col("least.row")))
    linked = link_classes(classes.select("rep", "bands"), sig)
    at = classes.select("set_key", "rep", "least", "copies").join(linked, "rep", "left").where("copies > 1 or component is not null")
    at = stored(at.select("set_key", "least", F.coalesce("component", "rep").alias("component")))
    first = at.groupBy("component").agg(F.min("least").alias("least"))
    return at.select("set_key", "component").join(first, "component").select("set_key", F.col("least.doc_id").alias("to_id"), F.col("least.row").alias("to_row")), at.count()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links: equal shingle sets, and sets with 100 * intersection >= 75 * union. component_id is the smallest doc_id
    reachable; kept says that it is the row's own. Null and blank texts have no shingles and stand alone. Rows are judged by
    their own text, not their id: equal rows repeat in the result, and different texts under one doc_id, or without one, are
    linked as any others. component_id is null where no row reachable has an id; kept holds for those too. Columns
    beside doc_id and text, whatever their names, are ignored. Long texts are hashed whole, in blocks. An empty table gives no rows.
    """
    sig = signatures(docs)
    to, n = _classes(sig)
    found = sig.select("doc_id", "n_shingles", "set_key").join(maybe_broadcast(to, n, 32), "set_key", "left")
    component = F.when(F.col("to_row").isNull(), F.col("doc_id")).otherwise(F.col("to_id"))
    return found.withColumn("component_id", component).select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents; its docstring says what nulls, blank texts and repeated ids give."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one row of each component stays, the one with the smallest doc_id, those without an id last.

    Rows are told apart by their place in the table, so different texts under one doc_id stay when nothing resembles them.
    Only numbers of the rows that go are dealt, to where the rows lie; texts don't move. Null and blank texts stay; an empty table stays empty; all columns pass through under any names.
    """
    sig = signatures(docs, whole=True)
    to, n = _classes(sig)
    gone = sig.select("row", "set_key").join(maybe_broadcast(to, n, 32), "set_key").where("row <> to_row").select("row")
    kept = sig.join(on_task(gone, "row"), ["task", "row"], "left_anti")
    return kept.select(*[F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


OP1_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, len(s) AS n_shingles, component_id, component_id = doc_id AS kept FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)"""


__all__ = ["OP1_SQL", "SHINGLE", "compare", "connected_components", "near_duplicates", "op1_near_dedup", "signatures", "stage"]
