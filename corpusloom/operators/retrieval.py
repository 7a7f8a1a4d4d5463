"""Retrieval for a table of queries: BM25, full text, fusion, reranking, gate, parents and context."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import coverage_score, tokenize, tokenize_fts
from corpusloom.sources.workspace import small_batches, stored

#: BM25's parameters, fusion's constant, thresholds of gate and context.
K1, B, RRF_K, GATE, CONTEXT = 1.5, 0.75, 60, 0.50, 0.20
#: Bytes of asked terms, and of rows, that are broadcast. Larger tables of queries are asked in blocks of that size.
ASKED_BYTES = 16 << 20
#: Products of a posting and a query, and cells of documents by queries, that a task holds at once.
CELLS = 1 << 20

Tokenizer = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]


def postings(docs: DataFrame, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(doc_id, term, tf). tokenizer: an array of tokens from a text."""
    return docs.select("doc_id", F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, len, terms, tf): the distinct terms of each document of docs (doc_id, t), and how often each stands there. Nothing is dealt."""

    def run(batches):
        for batch in batches:
            words = batch.column(1)
            sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            coded = words.flatten().dictionary_encode()
            term = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            held, tf = np.unique(row[term >= 0] * max(1, len(coded.dictionary)) + term[term >= 0], return_counts=True)
            row, term = np.divmod(held, max(1, len(coded.dictionary)))
            ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (coded.dictionary.take(pa.array(term, pa.int64())), pa.array(tf, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists], ["doc_id", "len", "terms", "tf"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, len int, terms array<string>, tf array<int>")


def bm25_index(docs: DataFrame, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(doc_id, term, tf, df, idf, len, avgdl): the index as one table, to be written once and asked often.

    Terms are counted where a text is read, and the counts stored there. What is dealt is each task's distinct terms, for df, and the
    postings of terms that are too rare for the broadcast of the most frequent ones, as many as ASKED_BYTES hold. Rows of one doc_id
    are one document.
    """
    each = docs.select("doc_id", F.coalesce(tokenizer(F.col("text")), F.array().cast("array<string>")).alias("t"))
    shared = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id")))
    if not shared.isEmpty():
        same, shared = F.col("doc_id").eqNullSafe(F.col("id")), _small(shared)
        joined = each.join(shared, same, "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list("t")).alias("t"))
        each = each.join(shared, same, "left_anti").unionByName(joined)
    rows = stored(counted(each)).select("doc_id", "len", F.inline(F.arrays_zip(F.col("terms").alias("term"), "tf")))
    df = stored(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("tf").cast("long")).alias("total")))
    total, n = df.agg(F.sum("total")).first()[0] or 0, docs.count()
    least, left = 1, ASKED_BYTES // 64
    for value, terms in sorted(map(tuple, df.groupBy("df").count().collect()), reverse=True):  # few: the square of their number is below the postings' twice
        left -= terms
        if left < 0:
            least = value + 1
            break
    df = df.select("term", "df")
    held = rows.where("doc_id IS NOT NULL").join(F.broadcast(df.where(F.col("df") >= least)), "term", "left")
    found = held.where("df IS NOT NULL")
    if least > 1:
        rare = held.where("df IS NULL").drop("df").join(df.where(F.col("df") < least), "term")
        found = found.unionByName(rare)
    avgdl = F.lit(total / n if n else None).cast("double")
    return found.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), "df", idf(F.lit(n), F.col("df")).alias("idf"), F.col("len").cast("long").alias("len"), avgdl.alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the frame, in 64 bytes a row, takes no more than ASKED_BYTES; its rows are counted."""
    most = ASKED_BYTES // 64
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _numbered(docs: DataFrame, vocabulary: pa.Array, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, len, terms, tf) of all documents: numbers of the asked terms that each holds, ascending, and how often. Texts are split once, and nothing is dealt."""
    rows = docs.select("doc_id", F.coalesce(tokenizer(F.col("text")), F.array().cast("array<string>")).alias("t"))

    def run(batches):
        for batch in batches:
            words = batch.column(1)
            sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            term = pc.fill_null(pc.index_in(words.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            held, tf = np.unique(row[term >= 0] * max(1, len(vocabulary)) + term[term >= 0], return_counts=True)
            row, term = np.divmod(held, max(1, len(vocabulary)))
            ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists], ["doc_id", "len", "terms", "tf"])

    small_batches(docs.sparkSession)
    return stored(rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, len int, terms array<int>, tf array<int>"))


def _best(query: np.ndarray, score: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties to the smaller document, by query and rank."""
    order = np.lexsort((np.unique(docs, return_inverse=True)[1], -score, query))
    query, score, docs = query[order], score[order], docs[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], score[keep], docs[keep]


def _scored_top(held: DataFrame, asked: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, k: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray], places: int | None = 9) -> DataFrame:
    """(query, doc_id, score): each task's k best documents of each of n queries. asked: start of each term's rows, their queries and factors.

    A score sums factor * part(tf, len) over the asked terms, rounded to `places`, or left as it is where these are whole numbers: rounding
    a large one to places below its last bit would move it. A task goes through its documents in slices of bounded
    size and passes on n times k rows at most, however many documents there are.
    """
    shared = held.sparkSession.sparkContext.broadcast(asked)
    kind = held.schema["doc_id"].dataType.simpleString()

    def run(batches):
        start, whose, factor = shared.value
        best, new, least, to = None, [], np.zeros(n), None

        def merged():
            query, score, ids = _best(*map(np.concatenate, zip(*([best] if best else []), *new, strict=True)), k)
            full = np.flatnonzero(np.bincount(query, minlength=n) >= k)
            least[full] = score[np.searchsorted(query, full, side="right") - 1]
            return query, score, ids

        for batch in batches:
            lengths, docs, to = batch.column(1).to_numpy(), batch.column(0).to_numpy(zero_copy_only=False), batch.column(0).type
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            term, tf = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            row = np.repeat(np.arange(len(docs)), sizes)
            value = part(tf, lengths[row])
            many = start[term + 1] - start[term]
            cost = np.cumsum(np.bincount(row, weights=many, minlength=len(docs)) + n)
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(cost // CELLS)) + 1, [len(docs)]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                i, j = np.searchsorted(row, (a, b))
                each = np.repeat(np.arange(i, j), many[i:j])
                at = np.arange(len(each)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j]) + start[term[each]]
                scores = np.bincount((row[each] - a) * n + whose[at], weights=factor[at] * value[each], minlength=(b - a) * n).reshape(b - a, n)
                scores = scores if places is None else np.round(scores, places)
                r, q = np.nonzero((scores > 0) & (scores >= least))
                new.append((q, scores[r, q], docs[a + r]))
                if sum(len(x[0]) for x in new) >= n * k:
                    best, new = merged(), []
        if new:
            best = merged()
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int32()), pa.array(best[2], to), pa.array(best[1], pa.float64())], ["query", "doc_id", "score"])

    return held.mapInArrow(run, f"query int, doc_id {kind}, score double")


def _asked_top(asked: DataFrame, docs: DataFrame, k: int, tokenizer: Tokenizer, factor: Callable[[np.ndarray, int], np.ndarray] | None, part: Callable[[np.ndarray, np.ndarray, float], np.ndarray]) -> DataFrame:
    """(query_id, doc_id, score) with the k best of every query of asked (query_id, term, qtf), and some more.

    factor: of a term's df and the number of documents, or None for 1 and scores in whole numbers; part: of tf, len and the mean length. More queries than ASKED_BYTES
    hold go over the documents in blocks, dealt by a hash, so that neither driver nor task holds more than a block's terms.
    """
    asked = stored(asked.where("term IS NOT NULL"))
    blocks = max(1, -(-asked.count() // max(1, ASKED_BYTES // 64)))
    found = None
    for i in range(blocks):
        one = _block_top(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), docs, k, tokenizer, factor, part)
        found = one if found is None else found.unionByName(one)
    return found


def _block_top(asked: DataFrame, docs: DataFrame, k: int, tokenizer: Tokenizer, factor, part) -> DataFrame:
    mine = asked.toArrow()
    words, queries = pc.unique(mine["term"]), pc.unique(mine["query_id"])
    term, whose = (pc.index_in(mine[c], v).to_numpy() for c, v in (("term", words), ("query_id", queries)))
    held = _numbered(docs, words, tokenizer)
    times = mine["qtf"].to_numpy().astype(np.float64)
    mean = 0.0
    if factor is not None:
        n, total = held.agg(F.count(F.lit(1)), F.sum("len")).first()
        mean = (total or 0) / max(1, n)
        df = np.zeros(len(words))
        for t, m in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term
            df[t] = m
        times = times * factor(df, n)[term]
    order = np.lexsort((whose, term))
    start = np.searchsorted(term[order], np.arange(len(words) + 1))
    found = _scored_top(held, (start, whose[order], times[order]), len(queries), k, lambda tf, length: part(tf, length, mean), None if factor is None else 9)
    spark = docs.sparkSession
    names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(queries)), pa.int32()), "query_id": queries}), f"query int, query_id {asked.schema['query_id'].dataType.simpleString()}")
    return stored(found.join(F.broadcast(names), "query").select("query_id", "doc_id", "score"))


def _top(scored: DataFrame, order: list[Column], k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 15, index: DataFrame | None = None, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(query_id, doc_id, score, rank) for queries (query_id, text); a token that stands twice counts twice. doc_id is a key.

    Only the postings of asked terms are kept, beside their document; tasks score their own documents and pass on their k best of each
    query, so what is dealt doesn't grow with the documents; many queries go in blocks. With a stored bm25_index() the texts aren't read at
    all; for very many queries, lexical_index.build() makes an index whose topk() reads few postings. Scores are rounded to 9 places before ranking; ties go to
    the smaller id.
    """
    asked = queries.select("query_id", F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    if index is None:
        scored = _asked_top(asked, docs, k, tokenizer, lambda df, n: np.log(1 + (n - df + 0.5) / (df + 0.5)), lambda tf, length, mean: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9))))
    else:
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
        scored = index.join(_small(asked), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    return _top(scored, [F.desc("score"), F.asc("doc_id")], k)


def fts_topk(queries: DataFrame, docs: DataFrame, k: int = 15) -> DataFrame:
    """(query_id, doc_id, matched, tf, rank): any content token matches; more distinct tokens first, then more of them."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenize_fts(F.col("text")))).alias("term"))
    # matched and tf as one number, which doubles hold exactly for up to 2**21 terms and counts below 2**32
    scored = _asked_top(asked.withColumn("qtf", F.lit(1)), docs, k, tokenize, None, lambda tf, length, mean: tf + 2.0**32)
    both = F.col("score").cast("long")
    hits = scored.select("query_id", "doc_id", F.shiftright(both, 32).alias("matched"), both.bitwiseAND((1 << 32) - 1).alias("tf"))
    return _top(hits, [F.desc("matched"), F.desc("tf"), F.asc("doc_id")], k)


def sparse_topk(queries: DataFrame, docs: DataFrame, k: int = 15, engine: str = "fts") -> DataFrame:
    found = fts_topk(queries, docs, k) if engine == "fts" else bm25_topk(queries, docs, k)
    return found.select("query_id", "doc_id", "rank", F.lit(engine).alias("sparse_engine"))


def rrf_fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, rrf, rank) from ranked lists (query_id, list_id, rank, doc_id); ties go to the first to appear."""
    fused = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("rrf"), F.min(F.struct("list_id", "rank")).alias("first"))
    return _top(fused, [F.desc("rrf"), F.asc("first"), F.asc("doc_id")], 2**31 - 1).drop("first")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def lexical_score(text: Column, query: Column) -> Column:
    """The default pair scorer: a sigmoid of how much of the query the text covers."""
    return sigmoid(8 * coverage_score(text, query) - 4)


def with_text(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked rows with the columns of their documents. The rows are stored; few are sent to the texts, which then stay where they are."""
    return _small(stored(ranked)).join(docs, "doc_id")


def rerank_topk(fused: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 5, scorer: Scorer = lexical_score) -> DataFrame:
    """fused with `cross`, the scorer's value of a (text, query) pair, and its k best per query. A Pandas UDF may be the scorer."""
    pairs = with_text(fused.join(queries.select("query_id", F.col("text").alias("q")), "query_id"), docs.select("doc_id", "text"))
    scored = pairs.select("query_id", "doc_id", F.col("rank").alias("fused_rank"), "rrf", F.round(scorer(F.col("text"), F.col("q")), 9).alias("cross"))
    return _top(scored, [F.desc("cross"), F.asc("fused_rank")], k)


def rerank_fallback(fused: DataFrame, k: int = 5, otherwise: float = 0.75) -> DataFrame:
    """The first k, with the score they have: cross, else similarity, else a constant."""
    cut = fused.where(F.col("rank") <= k).withColumn("score", F.coalesce("cross", "similarity", F.lit(otherwise))).withColumnRenamed("rank", "fused_rank")
    return _top(cut, [F.desc("score"), F.asc("fused_rank")], k)


def crag_gate(queries: DataFrame, reranked: DataFrame, least: float = GATE) -> DataFrame:
    """(query_id, best, needs_web_fallback, path_used): queries without rows have best 0."""
    best = reranked.groupBy("query_id").agg(F.max("cross").alias("best"))
    all_ = queries.select("query_id").join(best, "query_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return all_.withColumn("needs_web_fallback", F.col("best") < least).withColumn("path_used", F.when(F.col("best") < least, "web").otherwise("vector"))


def context_filter(queries: DataFrame, reranked: DataFrame, least: float = CONTEXT) -> DataFrame:
    """(query_id, n, grounded): rows that may enter the context, and whether there are any and the gate is passed."""
    n = reranked.where(F.col("cross") >= least).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("cross").alias("best"))
    all_ = queries.select("query_id").join(n, "query_id", "left")
    return all_.select("query_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("best") >= GATE, F.lit(False)).alias("grounded"))


def expand_to_parents(ranked: DataFrame, parents: DataFrame) -> DataFrame:
    """Ranked chunks (query_id, chunk_id, parent_id, rank, text) with the parent's text; the best child stands for its parent.

    Chunks without a parent, or whose parent has no row, pass through.
    """
    found = ranked.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")
    key = F.when(F.col("parent_text").isNotNull(), F.concat(F.lit("p"), F.col("parent_id"))).otherwise(F.concat(F.lit("c"), F.col("chunk_id")))
    first = found.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))).where("__n = 1")
    return first.select("query_id", "chunk_id", "parent_id", "rank", F.coalesce("parent_text", "text").alias("text"), F.col("text").alias("child_text"))


#: What stands for a context without chunks, and the cuts of contexts for two kinds of prompt.
NO_CONTEXT, LONG_CONTEXT, SHORT_CONTEXT = "No relevant context found.", 3500, 2500


def _blocks(rows: DataFrame, block: Column, most: int | None) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), block.alias("b"))))
    text = F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n")
    return rows.groupBy("query_id").agg((text if most is None else F.substring(text, 1, most)).alias("context"))


def build_context(ranked: DataFrame, most: int | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, context): blocks of source and text in the order of rank; with queries, those without rows say so."""
    block = F.concat(F.lit("[Source: "), F.col("source"), F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")]\n"), F.col("text"))
    found = _blocks(ranked, block, most)
    return found if queries is None else queries.select("query_id").join(found, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def web_context(results: DataFrame, most: int | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, context) of web results (query_id, rank, title, snippet, url); with queries, those without results are empty."""
    block = F.concat(F.lit("[WEB]: "), F.col("title"), F.lit("\n"), F.col("snippet"), F.lit("\n("), F.col("url"), F.lit(")"))
    found = _blocks(results, block, most)
    return found if queries is None else queries.select("query_id").join(found, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def source_list(ranked: DataFrame) -> DataFrame:
    """(query_id, sources, doc_ids): distinct names and ids behind an answer, sorted."""
    return ranked.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.array_join(F.transform(F.array_sort(F.collect_set("doc_id")), lambda x: x.cast("string")), ",").alias("doc_ids"))


def citations(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, citations, parent_ids): for every query its rows' (name, url, score, document_id) in the order of rank, and the distinct documents.

    ranked: query_id, rank, source, url, doc_id, cross, similarity. The score is cross, else similarity, else 0; rows without a document
    are cited, and left out of parent_ids.
    """
    cited = F.struct(F.col("source").alias("name"), "url", F.coalesce("cross", "similarity", F.lit(0.0)).alias("score"), F.col("doc_id").alias("document_id"))
    rows = F.array_sort(F.collect_list(F.struct("rank", cited.alias("c"))))
    found = ranked.groupBy("query_id").agg(F.transform(rows, lambda x: x["c"]).alias("citations"), F.array_sort(F.collect_set("doc_id")).alias("parent_ids"))
    whole = queries.select("query_id").join(found, "query_id", "left")
    none = lambda name: F.array().cast(dict(found.dtypes)[name])
    return whole.select("query_id", *[F.coalesce(c, none(c)).alias(c) for c in ("citations", "parent_ids")])


def overlap(a: DataFrame, b: DataFrame, first: int = 15) -> DataFrame:
    """(query_id, recalled, shared): how many of a's first rows are in b, and how many rows both have."""
    both = a.join(b.select("query_id", "doc_id"), ["query_id", "doc_id"])
    return both.groupBy("query_id").agg(F.count_if(F.col("rank") <= first).alias("recalled"), F.count(F.lit(1)).alias("shared"))
