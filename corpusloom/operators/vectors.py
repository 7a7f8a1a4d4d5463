"""Vectors: a hashed encoder in plain SQL, normalisation, checks, exact and cell-probing top-k."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import let, tokenize
from corpusloom.sources.workspace import stored

#: Queries, and corpus rows, of one block of an exact search: what a task holds.
QUERY_BLOCK, CORPUS_BLOCK = 2048, 16_384


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    return let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def valid(v: Column, dim: int) -> Column:
    """Of that dimension and finite."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def stale(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """Rows to embed anew: of another model, or not of `dim` finite numbers. vectors: model, vec."""
    return vectors.where(~(F.col("model").eqNullSafe(F.lit(model)) & valid(F.col("vec"), dim)))


def similarity_order(probes: DataFrame, key: str, order: str, anchor: str, other: str) -> DataFrame:
    """(key, ordered): whether a key's similarities with its anchor fall, or stay, from each probe to the next in order."""
    sims = probes.select(key, order, cosine(F.col(anchor), F.col(other)).alias("__sim"))
    before = F.lag("__sim").over(Window.partitionBy(key).orderBy(order))
    return sims.withColumn("__falls", F.coalesce(F.col("__sim") <= before + 1e-9, F.lit(True))).groupBy(key).agg(F.bool_and("__falls").alias("ordered"))


def embed_text(df: DataFrame, key: str, text: str, dim: int = 64, encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, vec): token counts hashed to `dim` places, normalised; texts without tokens have no row.

    An encoder, an array of numbers from a text (a Pandas UDF around a model, say), takes the place of the hashes; null
    vectors have no row.
    """
    if encoder is not None:
        return df.select(key, l2_normalize(encoder(F.col(text))).alias("vec")).where("vec is not null")
    tokens = df.select(key, F.explode(tokenize(F.col(text))).alias("t"))
    place = (F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % dim).cast("int")
    counts = tokens.groupBy(key, place.alias("d")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    dense = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return dense.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).alias("vec"))


def embed_distinct(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """embed_text with each distinct text encoded once."""
    hashed = df.select(key, F.sha2(text, 256).alias("h"), text)
    once = hashed.groupBy("h").agg(F.any_value(text).alias(text))
    return hashed.drop(text).join(embed_text(once, "h", text, dim), "h").select(key, "vec")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _local_top(ids: np.ndarray, sims: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of sims the k best columns of at least `least`, ties to smaller ids: (row, id, sim)."""
    r = np.round(sims, 9)
    out = []
    for i in range(len(r)):
        at = np.flatnonzero(r[i] >= least)
        if len(at) > k:
            cut = np.partition(r[i][at], len(at) - k)[len(at) - k]
            at = at[r[i][at] >= cut]
        at = at[np.lexsort((ids[at], -r[i][at]))][:k]
        out.append((np.full(len(at), i), ids[at], r[i][at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _ranked(local: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 15, least: float = 0.2, other_only: bool = False) -> DataFrame:
    """(query_id, id, sim, rank): exact cosine top-k of at least `least`. queries: query_id, vec; corpus: id, vec; unit vectors.

    Up to QUERY_BLOCK queries are broadcast, and each task multiplies them with its rows. More are dealt into blocks as rows of
    their own: each meets each block of the corpus in one group of bounded size, and nothing passes the driver. Every
    block passes on its k best, and a window merges those. sim is rounded to 9 places, ties go to the smaller id.
    """
    n, spark = queries.count(), queries.sparkSession
    schema = "query_id long, id long, sim double"
    asked, rows = queries.select(F.col("query_id").cast("long"), "vec"), corpus.select(F.col("id").cast("long"), "vec")

    def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> list[pa.Array]:
        sims = q @ vecs.T
        if other_only:
            sims[q_ids[:, None] == ids] = -np.inf
        row, at, s = _local_top(ids, sims, k, least)
        return [pa.array(q_ids[row], pa.int64()), pa.array(at, pa.int64()), pa.array(s, pa.float64())]

    if n == 0:
        return spark.createDataFrame([], schema + ", rank int")
    if n <= QUERY_BLOCK:
        mine = asked.toArrow()
        shared = spark.sparkContext.broadcast((mine["query_id"].to_numpy(), _matrix(mine["vec"].combine_chunks(), mine.num_rows)))

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays(best(*shared.value, batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows)), ["query_id", "id", "sim"])

        return _ranked(rows.mapInArrow(run, schema), k)
    blocks, parts = -(-n // QUERY_BLOCK), max(1, -(-corpus.count() // CORPUS_BLOCK))
    to = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    dealt = lambda key, many: F.pmod(F.xxhash64(key), F.lit(many)).cast("int")
    asked = asked.withColumn("block", dealt("query_id", blocks)).withColumn("part", to(parts))
    rows = rows.select("id", F.col("vec").alias("value"), dealt("id", parts).alias("its_part")).withColumn("its_block", to(blocks))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        if not (q.num_rows and c.num_rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], ["query_id", "id", "sim"])
        held = [_matrix(t[name].combine_chunks(), t.num_rows) for t, name in ((q, "vec"), (c, "value"))]
        return pa.table(best(q["query_id"].to_numpy(), held[0], c["id"].to_numpy(), held[1]), ["query_id", "id", "sim"])

    return _ranked(asked.groupBy("block", "part").cogroup(rows.groupBy("its_block", "its_part")).applyInArrow(meet, schema), k)


class Cells:
    """A corpus (id, vec; unit vectors) in cells around k-means centres, cut into rings by distance from the centre.

    The centres are fitted on a bounded sample; every vector is put into its nearest cell, and the rings' least and greatest
    distances and sizes are counted over all. A ring wider than RING_ROWS rows is cut by a hash of the id, so that no group
    grows with the corpus. What the driver holds is a row for each ring of each cell: up to 1,024 cells of RINGS rings.
    """

    RINGS, RING_ROWS = 16, 8192

    def __init__(self, corpus: DataFrame, cell_rows: int = 64, sample: int = 20_000) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = corpus.select(F.col("id").cast("long"), F.col("vec").cast("array<double>").alias("vec"))
        self.n = rows.count()
        cells = max(1, min(1024, self.n // cell_rows))
        fit = rows.orderBy(F.xxhash64("id")).limit(sample).select(array_to_vector("vec").alias("features"))
        self.centres = np.array(KMeans(k=cells, seed=7, maxIter=10).fit(fit).clusterCenters()) if cells > 1 else np.array(fit.first()["features"].toArray())[None, :] if self.n else np.empty((0, 1))
        centres, rings = self.centres, self.RINGS

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    d = _distances(_matrix(batch.column(1), batch.num_rows), centres)
                    at = d.argmin(axis=1)
                    near = d[np.arange(len(at)), at]
                    ring = np.minimum((near * rings / 2).astype(np.int32), rings - 1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at * rings + ring, pa.int32()), pa.array(near)], ["id", "vec", "block", "near"])

        placed = stored(rows.mapInArrow(place, "id long, vec array<double>, block int, near double"))
        blocks = sorted(map(tuple, placed.groupBy("block").agg(F.min("near"), F.max("near"), F.count(F.lit(1))).collect()))
        self.block, self.low, self.high, self.size = (np.array(x) for x in (list(zip(*blocks, strict=True)) or [[], [], [], []]))
        parts = {int(b): -(-int(size) // self.RING_ROWS) for b, _, _, size in blocks}
        cuts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for b, m in parts.items() if m > 1 for x in (b, m)] or [F.lit(-1), F.lit(1)]), F.col("block")), F.lit(1))
        self.parts = parts
        self.rows = placed.select("id", "vec", F.col("block").alias("its"), F.pmod(F.xxhash64("id"), cuts).cast("int").alias("part"))

    def bounds(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function of queries: for each of them and each block, how near its vectors can be at best, by the triangle of query, centre and vector."""
        centres, at, low, high = self.centres, (self.block // self.RINGS).astype(int), self.low, self.high

        def run(q: np.ndarray) -> np.ndarray:
            d = _distances(q, centres)[:, at]
            return np.maximum(0.0, np.maximum(d - high, low - d))

        return run


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)))


def ann_topk(queries: DataFrame, corpus: DataFrame, k: int = 15, cells: Cells | None = None, first: int = 4, slack: float = 0.0) -> DataFrame:
    """dense_topk() without a threshold, by asking only cells that can hold one of the k best: (query_id, id, sim, rank, scored).

    A query asks the blocks nearest to it until they hold `first` times k vectors. The k-th best of those bounds what is
    sought: in the second round it asks every block that the triangle bound doesn't rule out, so the result is exact. With slack, blocks
    that could be nearer than the k-th by less than that share are left out, and the result is approximate. scored counts
    the vectors that the query was compared with; it is a few cells where the corpus is clustered, and all where it isn't.
    """
    cells = cells or Cells(corpus)
    names, margin = "query_id long, q array<double>, block int, scored long", 1e-6
    bounds, block, size = cells.bounds(), cells.block, cells.size

    def ask(second: bool):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                bound = bounds(_matrix(batch.column(1), batch.num_rows))
                order = np.argsort(bound, axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1)
                inside = np.zeros(bound.shape, bool)
                np.put_along_axis(inside, order, held - size[order] < first * k, axis=1)
                if second:
                    kth = batch.column(2).to_numpy(zero_copy_only=False)
                    reach = np.sqrt(np.maximum(0.0, 2 - 2 * kth)) * (1 - slack) + margin
                    inside = ~inside & ((bound <= reach[:, None]) | np.isnan(kth)[:, None])
                row, at = np.nonzero(inside)
                scored = (inside * size).sum(axis=1)
                for i in range(0, len(row), 1024):
                    some = pa.array(row[i : i + 1024])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(block[at[i : i + 1024]], pa.int32()), pa.array(scored[row[i : i + 1024]], pa.int64())], ["query_id", "q", "block", "scored"])

        return run

    def met(q: pa.Table, v: pa.Table) -> pa.Table:
        if not (q.num_rows and v.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        ids, out = q["query_id"].to_numpy(), []
        vecs = _matrix(v["vec"].combine_chunks(), v.num_rows)
        for i in range(0, q.num_rows, QUERY_BLOCK):
            part = _matrix(q["q"].slice(i, QUERY_BLOCK).combine_chunks(), min(QUERY_BLOCK, q.num_rows - i))
            row, best, s = _local_top(v["id"].to_numpy(), part @ vecs.T, k, -1.0)
            out.append(pa.table({"query_id": pa.array(ids[i + row], pa.int64()), "id": pa.array(best, pa.int64()), "sim": pa.array(s, pa.float64())}))
        return pa.concat_tables(out)

    def found(asked: DataFrame) -> DataFrame:
        parts = {b: m for b, m in cells.parts.items() if m > 1}
        many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for b, m in parts.items() for x in (b, m)] or [F.lit(-1), F.lit(1)]), F.col("block")), F.lit(1))
        each = asked.withColumn("cut", F.explode(F.sequence(F.lit(0), many - 1)))
        return each.groupBy("block", "cut").cogroup(cells.rows.groupBy("its", "part")).applyInArrow(met, "query_id long, id long, sim double")

    if not cells.n:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, sim double, rank int, scored long")
    asked = queries.select(F.col("query_id").cast("long"), F.col("vec").cast("array<double>").alias("vec"))
    one = stored(asked.mapInArrow(ask(False), names))
    near = stored(_ranked(found(one), k).drop("rank"))
    kth = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(float("nan"))).alias("kth"))
    two = stored(asked.join(kth, "query_id").select("query_id", "vec", "kth").mapInArrow(ask(True), names))
    scored = one.select("query_id", "scored").distinct().unionByName(two.select("query_id", "scored").distinct()).groupBy("query_id").agg(F.sum("scored").alias("scored"))
    return _ranked(near.unionByName(found(two)), k).join(scored, "query_id")
