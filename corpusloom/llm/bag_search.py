"""Ranked lexical search by bag deduplication: documents cut down to the items' vocabulary, equal bags scored once."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import per_batch, stored, table
from .license_scan import split

#: Bytes of items that are asked together; their vocabulary goes to each worker. Larger item tables are asked in several parts.
PART_BYTES = 4 << 20
#: Scores of (class, item) that a worker holds at once, and contributions it adds up at once.
CELLS, SPREAD = 1 << 20, 1 << 21


def _bags(vocabulary):
    """Per text the number of its terms, and its bag: sorted (term number, occurrences) of vocabulary terms as unsigned 32-bit integers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers, n, bags = vocabulary.value, [], []
        for text in batch.column(1).to_pylist():
            ws = split(text)
            found = Counter(map(numbers.get, ws))
            found.pop(None, None)
            n.append(len(ws))
            bags.append(np.array(sorted(found.items()), "<u4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(bags, pa.binary())], ["id", "n", "bag"])

    return per_batch(run)


def _counts(batches):
    """(term, df) of a task's documents, and under -1 and -2 the documents with terms and all their terms."""
    total = Counter()
    for batch in batches:
        n = batch.column(0).to_numpy()
        total[-1] += int((n > 0).sum())
        total[-2] += int(n.sum())
        terms = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4")[::2]
        total.update(dict(zip(*(x.tolist() for x in np.unique(terms, return_counts=True)), strict=True)))
    if total:
        yield pa.RecordBatch.from_pydict({"term": pa.array(total.keys(), pa.int64()), "df": pa.array(total.values(), pa.int64())})


class _Best:
    """The k best classes of each item that a task has met: highest score first, then the smallest first id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least, self.most = k, np.ones(items), 4 * items * k + 10_000
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, item: np.ndarray, score: np.ndarray, none: np.ndarray, first: np.ndarray, members: pa.Array) -> None:
        self.held.append((item, score, none, first, members))
        self.rows += len(item)
        if self.rows > self.most:
            self.cut()

    def cut(self) -> tuple:
        item, score, none, first = (np.concatenate(x) for x in list(zip(*self.held, strict=True))[:4])
        order = np.lexsort((first, none, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        last = order[place == self.k - 1]
        self.least[item[last]] = score[last]
        order = order[place < self.k]
        members = pa.concat_arrays([x[4] for x in self.held]).take(pa.array(order))
        self.held, self.rows = [(item[order], score[order], none[order], first[order], members)], len(order)
        return self.held[0]


def _score(batch: pa.RecordBatch, weights: np.ndarray, starts: np.ndarray, postings: np.ndarray, items: int, best: _Best) -> None:
    """Add a batch's classes (bag, m, members) to the best of each item.

    Sums are exact in doubles: a term adds a whole number below 1000 * ln(2**64) * 10**6, and a part's items have under
    PART_BYTES terms, which keeps them under 2**58 only in theory and far under 2**53 for any item of fewer than 100,000 terms;
    longer ones are added in 64-bit integers.
    """
    bags, m, members = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
    sizes = np.array([len(b) // 8 for b in bags])
    flat = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2)
    term, tf = flat[:, 0], flat[:, 1].astype(np.int64)
    part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))
    spread = starts[term + 1] - starts[term]
    at = np.concatenate([[0], np.cumsum(sizes)])
    cost = np.concatenate([[0], np.cumsum(spread)])[at]
    ids = members.flatten()
    first_at = members.offsets.to_numpy()[:-1] - members.offsets[0].as_py()
    none = np.asarray(ids.is_null())[first_at]
    first = ids.fill_null(0).to_numpy()[first_at]
    a = 0
    while a < len(bags):
        b = min(a + max(1, CELLS // items), max(a + 1, int(np.searchsorted(cost, cost[a] + SPREAD, side="right")) - 1), len(bags))
        mine = slice(at[a], at[b])
        times = spread[mine]
        place = np.arange(times.sum()) + np.repeat(starts[term[mine]] - (np.cumsum(times) - times), times)
        cell = np.repeat(np.repeat(np.arange(b - a), sizes[a:b]), times) * items + postings[place]
        if len(weights) < 100_000:
            scores = np.bincount(cell, np.repeat(part[mine], times), minlength=(b - a) * items)
        else:
            scores = np.zeros((b - a) * items, np.int64)
            np.add.at(scores, cell, np.repeat(part[mine], times))
        scores = scores.reshape(b - a, items)
        row, item = np.nonzero(scores >= best.least)
        if len(row):
            best.add(item, scores[row, item].astype(np.int64), none[a + row], first[a + row], members.take(pa.array(a + row)))
        a = b


def _part(docs: DataFrame, items: pa.Table, k: int) -> DataFrame:
    """search() for items that fit a worker."""
    spark = docs.sparkSession
    each = [sorted(set(split(t))) for t in items["text"].to_pylist()]
    words = sorted({w for ws in each for w in ws})
    numbers = {w: i for i, w in enumerate(words)}
    vocabulary = spark.sparkContext.broadcast(numbers)
    bags = stored(docs.mapInArrow(_bags(vocabulary), "id long, n long, bag binary"))
    counts = {r["term"]: r["df"] for r in bags.select("n", "bag").mapInArrow(_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    n, total = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts[i] + 1))) if i in counts else 0 for i in range(len(words))], np.int64)
    postings = [[] for _ in words]
    for i, ws in enumerate(each):
        for w in ws:
            postings[numbers[w]].append(i)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in postings], dtype=np.int64)]).astype(np.int64)
    shared = spark.sparkContext.broadcast((weights, starts, np.array([i for p in postings for i in p], np.int64), len(each)))
    held = bags.where(F.length("bag") > 0).select("id", "bag", F.expr(f"100 - 90 + ((90 * n * {n}L) div {max(total, 1)}L)").alias("m")).withColumn("h", F.xxhash64("bag", "m"))
    of_class = ["h", "bag", "m"]
    first = held.withColumn("__n", F.row_number().over(Window.partitionBy(*of_class).orderBy(F.asc_nulls_last("id")))).where(F.col("__n") <= k)
    members = F.transform(F.array_sort(F.collect_list(F.struct("__n", "id"))), lambda x: x["id"])
    classes = first.groupBy(*of_class).agg(members.alias("members")).select("bag", "m", "members")

    def run(batches):
        weights, starts, places, size = shared.value
        best = _Best(size, k)
        for batch in batches:
            if batch.num_rows:
                _score(batch, weights, starts, places, size, best)
        if best.held:
            item, score, _, _, ids = best.cut()
            for a in range(0, len(item), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(item[a : a + 1000], pa.int32()), pa.array(score[a : a + 1000]), ids[a : a + 1000]], ["item", "score", "members"])

    found = classes.mapInArrow(run, "item int, score long, members array<long>").select("item", "score", F.explode("members").alias("doc_id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items["item_id"].to_pylist())), "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0; ties go to the smaller doc_id.

    docs: doc_id, text; items: item_id, text. A document becomes the bag of its terms that any item has, with occurrences, and
    its length class m; documents with equal bags and m (grouped by a hash, and compared in full) score alike, so they
    are one class, scored once against all items, and only its k smallest ids can be in a result. Frequencies count
    all documents. A task keeps the k best classes of each item; a window ranks what the tasks keep.
    Texts are read whole; null and empty ones have no terms and match nothing; null ids rank behind others; repeated
    documents are ranked each, repeated items are answered each. No items, or no documents, give no rows. Other columns
    aren't read, whatever their names.
    """
    asked = stored(items.select(F.col("item_id").cast("long"), "text"))
    parts = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for p in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).toArrow()
        found = _part(rows, mine, k) if mine.num_rows else None
        out = found if out is None else out.unionByName(found) if found is not None else out
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() of all documents for every benchmark item; its docstring says what nulls, ties, repeats and empty tables give."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP12_SQL = f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
st AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM dl),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
m AS (SELECT doc_id, 100 - 90 + ((90 * n * n_docs) // total) AS m FROM dl, st),
q AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10"""
