"""Exact BM25 top-k for about as many queries as documents: a floor for each query first, then only postings that may still reach it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import tokenize
from corpusloom.sources.workspace import stored

from . import retrieval
from .retrieval import B, K1, Tokenizer

#: Rows of asked terms that driver and tasks hold at once; those that a task bounds at once; and words that are numbered at once.
ROWS, CHUNK, WORDS = 1 << 21, 1 << 18, 1 << 21
#: Postings that a task holds at once, and how many classes of length their documents make.
HELD, CLASSES = 1 << 22, 16
#: A query's floor comes from its rarest words, until these stand in SEEDS documents, and there from the heaviest postings, about HEAVIEST
#: over all slices and one of each at least.
SEEDS, HEAVIEST = 128, 32
_EPS = 1e-8


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 15, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(query_id, doc_id, score, rank): exactly what retrieval.bm25_topk() gives, for very many queries.

    Texts are split once. Each query first scores some documents that hold its rarest words; the k-th best of them, over all tasks, is a
    floor for its result. Then a task goes through its documents by classes of like length. What a word can add there is its
    greatest weight in the class: the words that together stay below the floor are not read, but looked up in documents that another
    word of the query leads to, as long as these may still reach the floor. So nothing that may be among the k best is left out,
    and a frequent word meets few documents. A task passes on k rows at most of each query and slice of its documents.
    """
    asked = queries.select("query_id", F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = stored(asked.where("term IS NOT NULL"))
    words = stored(asked.select("term").distinct())
    many = asked.count()
    groups = 1 if words.count() <= WORDS else -(-many // WORDS)
    blocks = groups * max(1, -(-many // (groups * ROWS)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = None
    for g in range(groups):
        group = asked.where(block % groups == g)
        terms = words if groups == 1 else group.select("term").distinct()
        vocabulary = pc.unique(terms.toArrow()["term"])
        held = retrieval._numbered(docs, vocabulary, tokenizer)
        n, total = held.agg(F.count(F.lit(1)), F.sum("len")).first()
        counts = held.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
        df = np.zeros(len(vocabulary))
        df[counts["t"].to_numpy()] = counts["count"].to_numpy()
        for i in range(g, blocks, groups):
            one = _block_top(asked.where(block == i), held, vocabulary, df, n, (total or 0) / max(1, n), k)
            found = one if found is None else found.unionByName(one)
    return retrieval._top(found, [F.desc("score"), F.asc("doc_id")], k)


def _block_top(asked: DataFrame, held: DataFrame, vocabulary: pa.Array, df: np.ndarray, n: int, mean: float, k: int) -> DataFrame:
    """(query_id, doc_id, score) with the k best of every query of asked (query_id, term, qtf), and some more."""
    spark, mine = held.sparkSession, asked.toArrow()
    ids = pc.unique(mine["query_id"])
    term, whose = (pc.index_in(mine[c], v).to_numpy() for c, v in (("term", vocabulary), ("query_id", ids)))
    times = mine["qtf"].to_numpy() * np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
    order = np.lexsort((term, df[term], whose))
    term, whose, times = term[order], whose[order], times[order]
    start = np.searchsorted(whose, np.arange(len(ids) + 1))
    before = np.cumsum(df[term]) - df[term]
    seeds = np.flatnonzero(before - before[start[whose]] < SEEDS)
    shared = spark.sparkContext.broadcast((start, term, times, len(vocabulary)))
    kind, slice_, each, classes, chunk, cells = held.schema["doc_id"].dataType.simpleString(), HELD, max(1, round(HEAVIEST * HELD / max(1, df.sum()))), CLASSES, CHUNK, retrieval.CELLS

    def tell(query: np.ndarray, docs: pa.Array, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), docs, pa.array(score, pa.float64())], ["query", "doc_id", "score"])

    def run(of_slice: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
        def task(batches):
            asked, own = _Asked(*shared.value), {}  # own: what a task keeps from slice to slice
            for docs, *postings in _slices(batches, mean, slice_):
                query, score, doc = of_slice(asked, own, *postings)
                keep = retrieval._best(query, np.round(score, 9), docs.to_numpy(zero_copy_only=False)[doc], k)
                yield tell(keep[0], pa.array(keep[2], docs.type), keep[1])

        return held.mapInArrow(task, f"query int, doc_id {kind}, score double")

    rare = spark.sparkContext.broadcast(seeds)
    first = run(lambda asked, own, *postings: _seeded(asked, rare.value, each, *postings))
    kth = first.groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k).select("query", F.get("s", F.lit(k - 1)).alias("kth")).toArrow()
    floor = np.zeros(len(ids))
    floor[kth["query"].to_numpy()] = kth["kth"].to_numpy()
    floors = spark.sparkContext.broadcast(floor - _EPS)
    rows = stored(run(lambda asked, own, *postings: _above(asked, own.setdefault("floor", _Floor(floors.value, k)), classes, chunk, cells, *postings)))
    names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(ids)), pa.int32()), "query_id": ids}), f"query int, query_id {asked.schema['query_id'].dataType.simpleString()}")
    return rows.where("score > 0").join(retrieval._small(names), "query").select("query_id", "doc_id", "score")


def _slices(batches: Iterable[pa.RecordBatch], mean: float, most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, sizes, terms, weights) of a task's documents, in slices of about `most` postings, shorter documents first."""

    def one(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        lengths = t["len"].to_numpy()
        order = np.argsort(lengths, kind="stable")
        docs, terms, tf = (t[c].combine_chunks() for c in ("doc_id", "terms", "tf"))
        size = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        at = _runs((np.cumsum(size) - size)[order], size[order])
        tf, size = tf.flatten().to_numpy()[at], size[order]
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.repeat(lengths[order], size) / max(mean, 1e-9)))
        return docs.take(pa.array(order)), size, terms.flatten().to_numpy()[at], weight

    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += len(batch.column(2).flatten())
        if many >= most:
            yield one(held)
            held, many = [], 0
    if many:
        yield one(held)


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run of `many`, one run after the other."""
    return np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)


class _Asked:
    """Rows of asked terms by query: `start` of each query's, their terms and factors, and the number of terms."""

    def __init__(self, start: np.ndarray, term: np.ndarray, times: np.ndarray, n_terms: int) -> None:
        self.start, self.term, self.times, self.n_terms = start, term, times, n_terms

    def whole(self, key: np.ndarray, weight: np.ndarray, n: int, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and one of n documents in full, always added in the same order."""
        many = self.start[query + 1] - self.start[query]
        rows, pair = _runs(self.start[query], many), np.repeat(np.arange(len(query)), many)
        return np.bincount(pair, weights=self.times[rows] * _found(key, weight, self.term[rows], doc[pair], n), minlength=len(query))


def _found(key: np.ndarray, weight: np.ndarray, term: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Weights of terms in documents, 0 where they don't stand. key: term * n + doc, ascending."""
    wanted = term.astype(np.int64) * n + doc
    place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    return np.where(key[place] == wanted, weight[place], 0.0)


def _seeded(asked: _Asked, seeds: np.ndarray, each: int, size: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, scores and documents: full scores of the documents where a seed row's term is heaviest."""
    n = len(size)
    doc = np.repeat(np.arange(n), size)
    row_term = asked.term[seeds]
    wanted = np.zeros(asked.n_terms, bool)
    wanted[row_term] = True
    order = np.flatnonzero(wanted[term])
    order = order[np.lexsort((-weight[order], term[order]))]
    of = np.searchsorted(term[order], np.arange(asked.n_terms + 1))
    many = np.minimum((of[1:] - of[:-1])[row_term], each)
    whose = np.searchsorted(asked.start, seeds, side="right") - 1
    pairs = np.unique(np.repeat(whose, many) * n + doc[order][_runs(of[row_term], many)])
    key = term.astype(np.int64) * n + doc
    order = np.argsort(key)
    query, doc = np.divmod(pairs, n)
    return query, asked.whole(key[order], weight[order], n, query, doc), doc


class _Floor:
    """What a score must reach to count, for each query: the floor of all tasks, and the k-th best that this task has found so far."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.least, self.k, self.query, self.score = least.copy(), k, np.empty(0, np.int64), np.empty(0)

    def raise_(self, query: np.ndarray, score: np.ndarray) -> None:
        """With scores of documents not seen before."""
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        order = np.lexsort((-score, query))
        query, score = query[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.query, self.score = query[rank < self.k], score[rank < self.k]
        kth = rank == self.k - 1
        self.least[query[kth]] = np.maximum(self.least[query[kth]], score[kth] - _EPS)


def _above(asked: _Asked, floor: _Floor, classes: int, chunk: int, cells: int, size: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, scores and documents of all pairs whose score is at or above the query's floor, which each class raises."""
    ends = np.cumsum(size)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(1, classes) * ends[-1] / classes), [len(size)]]))
    steps = np.unique(np.concatenate([np.searchsorted(asked.start, np.arange(0, asked.start[-1], chunk)), [len(floor.least)]]))
    out = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        n, mine = y - x, slice(ends[x] - size[x], ends[y - 1])
        key = term[mine].astype(np.int64) * n + np.repeat(np.arange(n), size[x:y])
        if not len(key):
            continue
        order = np.argsort(key)
        key, held = key[order], weight[mine][order]
        doc_of = key % n
        of = np.searchsorted(key, np.arange(asked.n_terms + 1) * n)
        top, has = np.zeros(asked.n_terms), np.flatnonzero(np.diff(of))
        top[has] = np.maximum.reduceat(held, of[has])
        found = []
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            query, doc = _reach(asked, floor.least, cells, a, b, key, doc_of, held, n, of, top)
            score = asked.whole(key, held, n, query, doc)
            keep = score >= floor.least[query]
            found.append((query[keep], score[keep], doc[keep] + x))
        found = tuple(map(np.concatenate, zip(*found, strict=True)))
        floor.raise_(*found[:2])
        out.append(found)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _reach(asked: _Asked, floor: np.ndarray, cells: int, a: int, b: int, key: np.ndarray, doc_of: np.ndarray, held: np.ndarray, n: int, of: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of queries a to b and a class's n documents that may reach the floor, and all that do."""
    whose = np.repeat(np.arange(a, b), np.diff(asked.start[a : b + 1]))
    rows = np.arange(asked.start[a], asked.start[b])
    bound, many = asked.times[rows] * top[asked.term[rows]], (of[1:] - of[:-1])[asked.term[rows]]
    may = np.flatnonzero((many > 0) & (np.bincount(whose - a, weights=bound, minlength=b - a) >= floor[a:b])[whose - a])
    may = may[np.lexsort((bound[may] / many[may], whose[may]))]  # first those that add least for what they'd have us read
    rows, whose, bound, many = rows[may], whose[may], bound[may], many[may]
    first = np.searchsorted(whose, np.arange(a, b + 1))
    total = np.concatenate([[0.0], np.cumsum(bound)])
    # what a query's rows up to each can add; sums that run over many queries differ in the last bits, so a little more
    upto = total[1:] - total[first[whose - a]] + _EPS
    read = upto >= floor[whose]
    left = np.bincount(whose[~read] - a, minlength=b - a)  # a query's first rows, which aren't read
    rows_read = np.flatnonzero(read)
    cost = np.cumsum(many[read])
    at = np.searchsorted(cost, np.arange(cells, cost[-1] if len(cost) else 0, cells))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(whose[rows_read], whose[rows_read][at]), [len(rows_read)]]))
    queries, docs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        r = rows_read[i:j]
        hits, each = _runs(of[asked.term[rows[r]]], many[r]), np.repeat(r, many[r])
        pair = whose[each] * n + doc_of[hits]
        order = np.argsort(pair)
        pair, value = pair[order], (asked.times[rows[each]] * held[hits])[order]
        begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        (query, doc), score = np.divmod(pair[begin], n), np.add.reduceat(value, begin)
        more = left[query - a]
        while len(query):
            place = first[query - a] + more - 1
            open_ = score + np.where(more > 0, upto[place], _EPS) >= floor[query]
            ready = open_ & (more == 0)
            queries.append(query[ready])
            docs.append(doc[ready])
            open_ &= ~ready
            query, doc, score, more, place = (v[open_] for v in (query, doc, score, more, place))
            score = score + asked.times[rows[place]] * _found(key, held, asked.term[rows[place]], doc, n)
            more = more - 1
    return np.concatenate(queries), np.concatenate(docs)
