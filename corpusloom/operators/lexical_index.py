"""A BM25 index that is built once and asked often: bucketed postings in blocks of falling weight, and exact top-k that reads few of them."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import tokenize
from corpusloom.sources.workspace import stored

from . import retrieval
from .retrieval import B, K1, Tokenizer, counted, idf

#: Postings of a term lie in blocks by their weight without idf, which is below K1 + 1; a block spans LEVEL of it.
LEVEL = 0.1
#: Tokens of a shard, a part of the documents: SHARD if that makes no more than SHARDS shards a bucket, else more, up to MOST, which also bounds
#: a bucket on average. A task holds one shard's postings of asked terms at once.
SHARD, MOST, SHARDS = 1 << 19, 1 << 22, 4
#: Postings that a query reads of a part in its first round, and how many times more in each later one.
FIRST, GROWTH = 64, 4
_EPS = 1e-8


class LexicalIndex:
    """Tables at `path`: postings (term, shard, level, doc_id, tf, len), bucketed and sorted by term and shard; blocks
    (term, level, n, top, df, idf), with the greatest weight of each block; and stats (n, avgdl, avg_idf).

    Joins on (term, shard) leave the postings where they are. Opening a path that build() has written finds the index, in later
    sessions too.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.stats = spark.read.parquet(f"{path}/stats")
        stats = self.stats.first()
        self.buckets, self._mean = stats["buckets"], stats["avgdl"]
        self.name = _table(spark, path, self.buckets)
        self.read_rows = 0

    @property
    def postings(self) -> DataFrame:
        return self.spark.table(self.name).withColumn("weight", _weight(F.col("tf"), F.col("len"), self._mean))

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def topk(self, queries: DataFrame, k: int = 15) -> DataFrame:
        """(query_id, doc_id, score, rank): exactly what bm25_topk() gives, for as many queries as there are.

        Postings of asked terms are dealt once, by shard, whatever the number of queries that ask for them; a task finds the k best of its
        own documents and passes on k rows of a query and shard, however many documents have a word of it. There a query's blocks are read by how much each posting lowers the bound, rare terms first, in rounds
        that grow; after each, what a document not yet seen could still score is the sum of each term's next block's bound. The best of what
        was seen are looked up in full; once the k-th of them beats that sum, the query stops: only documents that the rest could lift to
        the k-th are looked up. Frequent words, whose bounds are small, so meet few documents. read_rows holds the postings read in rounds.
        Many queries are asked in blocks, as in bm25_topk().
        """
        asked = queries.select("query_id", F.explode(self._tokenizer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        asked = stored(asked.where("term IS NOT NULL"))
        blocks = max(1, -(-asked.count() // max(1, retrieval.ASKED_BYTES // 64)))
        self.read_rows = 0
        parts = [self._block_top(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k) for i in range(blocks)]
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
        return ranked.where(F.col("rank") <= k)

    def _block_top(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score) with the k best of every query of asked (query_id, term, qtf), and some more."""
        of_term = self.blocks.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.max("idf").alias("idf"))
        mine = asked.join(of_term, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("times")).toArrow()
        words, ids = pc.unique(mine["term"]), pc.unique(mine["query_id"])
        term, whose = (pc.index_in(mine[c], v).to_numpy() for c, v in (("term", words), ("query_id", ids)))
        order = np.lexsort((term, whose))
        start = np.searchsorted(whose[order], np.arange(len(ids) + 1))
        shared = self.spark.sparkContext.broadcast((start, term[order], mine["times"].to_numpy()[order], len(words)))
        limits = self._mean, k, FIRST, GROWTH, retrieval.CELLS
        numbers = self.spark.createDataFrame(pa.table({"term": words, "no": pa.array(np.arange(len(words)), pa.int32())}), "term string, no int")
        held = self.postings.join(F.broadcast(numbers), "term").select("shard", "no", "doc_id", F.col("tf").cast("int").alias("tf"), F.col("len").cast("int").alias("len"))
        rows = stored(held.groupBy("shard").applyInArrow(lambda t: _shard_top(t, shared.value, *limits), "query int, doc_id long, score double, read long"))
        self.read_rows += rows.agg(F.sum("read")).first()[0] or 0
        names = self.spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(ids)), pa.int32()), "query_id": ids}), f"query int, query_id {asked.schema['query_id'].dataType.simpleString()}")
        return rows.join(F.broadcast(names), "query").select("query_id", "doc_id", "score")

    _tokenizer: Tokenizer = staticmethod(tokenize)


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run of `many`, one run after the other."""
    return np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)


def _shard_top(t: pa.Table, asked: tuple[np.ndarray, np.ndarray, np.ndarray, int], mean: float, k: int, first: int, growth: int, cells: int) -> pa.Table:
    """Rows (query, doc_id, score) with a shard's k best documents of each query, and one without a query that tells how many postings were read.

    t: the shard's postings of asked terms. asked: start of each query's rows, their terms and factors, and the number of terms.
    """
    start, asked_term, times, n_terms = asked
    term, tf, length = (t[c].to_numpy() for c in ("no", "tf", "len"))
    weight = _weight(tf, length, mean)
    level = np.floor((K1 + 1 - weight) / LEVEL)
    docs, doc = np.unique(t["doc_id"].to_numpy(), return_inverse=True)
    order = np.lexsort((doc, level, term))
    term, level, weight, doc = term[order], level[order], weight[order], doc[order]
    begin = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (level[1:] != level[:-1])]))
    size, top, of = np.diff(np.append(begin, len(term))), np.maximum.reduceat(weight, begin), np.searchsorted(term[begin], np.arange(n_terms + 1))
    key = term.astype(np.int64) * len(docs) + doc
    order = np.argsort(key)
    key, of_key = key[order], weight[order]

    def whole(query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a document in full, always added in the same order."""
        many = start[query + 1] - start[query]
        rows, pair = _runs(start[query], many), np.repeat(np.arange(len(query)), many)
        wanted = asked_term[rows].astype(np.int64) * len(docs) + at[pair]
        place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        return np.bincount(pair, weights=np.where(key[place] == wanted, times[rows] * of_key[place], 0.0), minlength=len(query))

    found, read = [], 0
    step = max(1, cells // len(docs))
    for a in range(0, len(start) - 1, step):
        b = min(a + step, len(start) - 1)
        rows = np.arange(start[a], start[b])
        many = (of[1:] - of[:-1])[asked_term[rows]]
        row, block = np.repeat(rows - start[a], many), _runs(of[asked_term[rows]], many)
        query = np.repeat(np.arange(b - a), np.diff(start[a : b + 1]))
        bound = times[rows][row] * top[block]
        last = np.append(row[1:] != row[:-1], True)[: len(row)]
        won = (bound - np.where(last, 0.0, np.roll(bound, -1))) / size[block]
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        falling = np.full((len(rows), many.max(initial=0)), np.inf)
        falling[row, place] = won
        won = np.minimum.accumulate(falling, axis=1)[row, place]  # a term's blocks stay in their order
        order = np.lexsort((block, row, -won, query[row]))
        row, block, bound = row[order], block[order], bound[order]
        q, total = query[row], np.cumsum(size[block])
        before = np.concatenate([[0], total])[np.searchsorted(q, np.arange(b - a))]
        its = np.maximum(0, np.ceil(np.log((total - before[q]) / first) / np.log(growth))).astype(int)
        seen, active = np.zeros((b - a, len(docs))), np.ones(b - a, bool)
        for r in np.unique(its):
            now = (its == r) & active[q]
            if not now.any():
                continue
            n = size[block[now]]
            read += int(n.sum())
            hits, each = _runs(begin[block[now]], n), np.repeat(np.flatnonzero(now), n)
            seen += np.bincount(q[each] * len(docs) + doc[hits], weights=times[rows][row[each]] * weight[hits], minlength=seen.size).reshape(seen.shape)
            left = np.zeros(len(rows))
            np.maximum.at(left, row[its > r], bound[its > r])
            rest = np.bincount(query, weights=left, minlength=b - a)
            open_ = np.flatnonzero(active)
            best = np.argpartition(-seen[open_], min(2 * k, len(docs)) - 1, axis=1)[:, : 2 * k]
            full = whole(np.repeat(open_ + a, best.shape[1]), best.ravel()).reshape(best.shape)
            full[seen[open_[:, None], best] <= 0] = 0
            kth = np.zeros(b - a)
            if best.shape[1] >= k:
                kth[open_] = -np.partition(-full, k - 1, axis=1)[:, k - 1]
            more = np.bincount(q[its > r], minlength=b - a) > 0
            ends = active & (~more | (kth > rest + _EPS))
            at, d = np.nonzero((seen > 0) & (seen >= (kth - rest - _EPS)[:, None]) & ends[:, None])
            found.append(retrieval._best(at + a, np.round(whole(at + a, d), 9), docs[d], k))
            active &= ~ends
    each = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, int), np.empty(0), np.empty(0, int)]
    keep = each[1] > 0
    told = pa.table({"query": pa.array(each[0][keep], pa.int32()), "doc_id": pa.array(each[2][keep], pa.int64()), "score": pa.array(each[1][keep], pa.float64()), "read": pa.nulls(int(keep.sum()), pa.int64())})
    return pa.concat_tables([told, pa.table({"query": pa.nulls(1, pa.int32()), "doc_id": pa.nulls(1, pa.int64()), "score": pa.nulls(1, pa.float64()), "read": pa.array([read], pa.int64())})])


def _weight(tf, length, mean: float):
    """Of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    name = f"postings_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (term STRING, shard INT, level INT, doc_id BIGINT, tf BIGINT, len BIGINT) USING parquet CLUSTERED BY (term, shard) SORTED BY (term, shard) INTO {buckets} BUCKETS LOCATION '{path}/postings'")
    return name


def build(docs: DataFrame, path: str, buckets: int | None = None, tokenizer: Tokenizer = tokenize) -> LexicalIndex:
    """Write the index of docs (doc_id, a key; text) to a new path and open it. Buckets: as many as shuffle partitions, or more for many tokens, unless given.

    A posting is dealt once, and stored once; the texts are read twice, as weights need the mean length.
    """
    spark = docs.sparkSession
    each = docs.select("doc_id", F.coalesce(tokenizer(F.col("text")), F.array().cast("array<string>")).alias("t"))
    n, total = each.agg(F.count(F.lit(1)), F.sum(F.size("t").cast("long"))).first()
    total = total or 0
    mean = max(total, 1) / max(n, 1)
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // MOST))
    shards = max(1, min(SHARDS * buckets, -(-total // SHARD)), -(-total // MOST))
    each = counted(each).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    rows = each.select("shard", F.col("doc_id").cast("long").alias("doc_id"), "len", F.inline(F.arrays_zip(F.col("terms").alias("term"), "tf"))).repartition(buckets, "term", "shard")
    name = _table(spark, path, buckets)
    rows.select("term", "shard", F.floor((K1 + 1 - _weight(F.col("tf"), F.col("len"), mean)) / LEVEL).cast("int").alias("level"), "doc_id", F.col("tf").cast("long"), F.col("len").cast("long")).write.insertInto(name)
    spark.catalog.refreshTable(name)
    of_term = Window.partitionBy("term")
    each = spark.table(name).select("term", "level", _weight(F.col("tf"), F.col("len"), mean).alias("weight"))
    blocks = each.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("top")).withColumn("df", F.sum("n").over(of_term)).withColumn("idf", idf(F.lit(n), F.col("df")))
    blocks.write.parquet(f"{path}/blocks")
    terms = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.max("idf").alias("idf"))
    terms.agg(F.lit(n).cast("long").alias("n"), F.lit(mean).alias("avgdl"), F.avg("idf").alias("avg_idf"), F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/stats")
    found = LexicalIndex(spark, path)
    found._tokenizer = tokenizer
    return found
