"""Retrieval on benchmark x documents and on embeddings. Vector searches ask with every id divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, lexical_index
from corpusloom.operators import evaluate as E
from corpusloom.operators import retrieval as RT
from corpusloom.operators import vectors as V
from corpusloom.sources.workspace import stored, work_dir

from .base import Registry, load

R = Registry()
_STOP = ",".join(f"'{w}'" for w in dict.fromkeys(T.STOPWORDS))
TOK = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> '')"
FTS = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '[\\s-]+'), lambda x: length(x) > 1 AND x NOT IN (" + _STOP + "))"
#: Common table expressions of the oracles.
BASE = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf)::BIGINT AS len FROM tf GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, sum(len) / (SELECT count(*) FROM documents) AS avgdl FROM dl),
ix AS (SELECT tf.*, len, df, avgdl, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM tf JOIN dl USING (doc_id) JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term), st)"""


def _bm25(name: str, source: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) AS score FROM (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format('text')}) AS term FROM {source}) GROUP BY ALL) JOIN ix USING (term) GROUP BY ALL) WHERE score > 0) WHERE rank <= {k})"""


def _fts(name: str, source: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, tf DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, count(*) AS matched, sum(tf)::BIGINT AS tf FROM (SELECT DISTINCT query_id, unnest({FTS.format('text')}) AS term FROM {source}) JOIN tf USING (term) GROUP BY ALL)) WHERE rank <= {k})"""


def _embed(name: str, source: str, key: str) -> str:
    return f"""{name} AS (SELECT {key}, list_transform(l, lambda x: x / sqrt(list_sum(list_transform(l, lambda y: y * y)))) AS vec FROM (SELECT {key}, list(coalesce(n, 0)::DOUBLE ORDER BY d) AS l FROM (SELECT DISTINCT {key} FROM {source} WHERE len({TOK.format('text')}) > 0) CROSS JOIN (SELECT unnest(range(64)) AS d)
    LEFT JOIN (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS d, count(*) AS n FROM (SELECT {key}, unnest({TOK.format('text')}) AS t FROM {source}) GROUP BY ALL) USING ({key}, d) GROUP BY {key}))"""


def _dense(name: str, queries: str, corpus: str, k: int, least: float, also: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM (SELECT query_id, id, round(list_dot_product(q.vec, c.vec), 9) AS sim FROM {queries} q, {corpus} c WHERE {also}) WHERE sim >= {least}) WHERE rank <= {k})"""


_Q = "(SELECT item_id AS query_id, text FROM benchmark)"
_SUB = f"sub AS (SELECT item_id * 2 + j AS query_id, CASE WHEN j = 0 THEN text ELSE array_to_string(list_slice(t, len(t) // 2 + 1, len(t)), ' ') END AS text FROM (SELECT *, {TOK.format('text')} AS t FROM benchmark), (SELECT unnest([0, 1]) AS j))"


def asked(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def subqueries(s: SparkSession, d: str) -> DataFrame:
    """Two queries an item: its text, and the later half of its tokens; query_id is item_id * 2 + 0 or 1."""
    t = T.tokenize(F.col("text"))
    later = F.array_join(F.slice(t, F.floor(F.size(t) / 2).cast("int") + 1, F.size(t) + 1), " ")
    each = load(s, d, "benchmark").select("item_id", F.posexplode(F.array("text", later)).alias("j", "text"))
    return each.select((F.col("item_id") * 2 + F.col("j")).alias("query_id"), "text")


def indexed(s: SparkSession, d: str) -> lexical_index.LexicalIndex:
    return lexical_index.build(load(s, d, "documents"), work_dir(s, "index"))


def vectors(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "embeddings").select(F.col("vec_id").alias("id"), V.l2_normalize(F.col("embedding")).alias("vec"), "label")


def probes(v: DataFrame) -> DataFrame:
    return v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec")


_VEC = "v AS (SELECT vec_id AS id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS vec FROM (SELECT *, embedding::DOUBLE[] AS e FROM embeddings)), vq AS (SELECT id AS query_id, vec, label AS q_label FROM v WHERE id % 100 = 0)"
R.add("dense_topk", lambda s, d: V.dense_topk(probes(vectors(s, d)), vectors(s, d)).select("query_id", "id", F.round("sim", 6).alias("sim"), "rank"),
      f"WITH {_VEC}, {_dense('r', 'vq', 'v', 15, 0.2)} SELECT query_id, id, round(sim, 6) AS sim, rank FROM r")
R.add("ann_topk", lambda s, d: V.ann_topk(probes(vectors(s, d)), vectors(s, d)).select("query_id", "id", F.round("sim", 6).alias("sim"), "rank"),
      f"WITH {_VEC}, {_dense('r', 'vq', 'v', 15, -1)} SELECT query_id, id, round(sim, 6) AS sim, rank FROM r")
R.add("similarity_join", lambda s, d: V.dense_topk(probes(vectors(s, d)), vectors(s, d), k=100, least=-1.0, other_only=True).select("query_id", "id", F.round("sim", 6).alias("sim")),
      f"WITH {_VEC}, {_dense('r', 'vq', 'v', 100, -1, 'query_id <> id')} SELECT query_id, id, round(sim, 6) AS sim FROM r")
R.on("l2_normalize", "embeddings", lambda d: d.select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x")),
     f"WITH {_VEC} SELECT id AS vec_id, generate_subscripts(vec, 1) - 1 AS i, round(unnest(vec), 6) AS x FROM v")
R.on("validate_vectors", "embeddings", lambda d: d.groupBy(V.valid(F.col("embedding"), 64).alias("valid")).agg(F.count(F.lit(1)).alias("n")),
     "SELECT len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS valid, count(*) AS n FROM embeddings GROUP BY 1")
R.add("cosine_similarity", lambda s, d: _pairs(load(s, d, "embeddings")),
      "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")


def _pairs(v: DataFrame) -> DataFrame:
    """Each vector with its successor by id."""
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return v.join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("b")), 6).alias("sim"))


R.on("embed_text", "documents", lambda d: V.embed_text(d, "doc_id", "text").select("doc_id", F.posexplode("vec").alias("i", "x")).where("x > 0").select("doc_id", "i", F.round("x", 6).alias("x")),
     f"WITH {_embed('e', 'documents', 'doc_id')} SELECT * FROM (SELECT doc_id, generate_subscripts(vec, 1) - 1 AS i, round(unnest(vec), 6) AS x FROM e) WHERE x > 0")
R.on("embed_distinct", "documents", lambda d: V.embed_distinct(d, "doc_id", "text").select("doc_id", F.round(F.element_at("vec", 1), 6).alias("first")),
     f"WITH {_embed('e', 'documents', 'doc_id')} SELECT doc_id, round(vec[1], 6) AS first FROM e")
R.on("vector_space_check", "embeddings", lambda d: d.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")), "SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
R.add("bm25_topk", lambda s, d: RT.bm25_topk(asked(s, d), load(s, d, "documents")).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank"),
      f"WITH {BASE}, {_bm25('r', _Q, 15)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r")
R.add("bm25_stored_topk", lambda s, d: indexed(s, d).topk(asked(s, d)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank"),
      f"WITH {BASE}, {_bm25('r', _Q, 15)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r")
R.add("bm25_stored_terms", lambda s, d: indexed(s, d).blocks.groupBy("term").agg(F.sum("n").alias("df"), F.round(F.max("idf"), 6).alias("idf"), F.round(F.max("top"), 6).alias("top")),
      f"WITH {BASE} SELECT term, count(*) AS df, round(max(idf), 6) AS idf, round(max(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS top FROM ix GROUP BY term")
R.add("bm25_stored_stats", lambda s, d: indexed(s, d).stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf")),
      f"WITH {BASE} SELECT (SELECT n FROM st) AS n, round((SELECT avgdl FROM st), 6) AS avgdl, round(avg(idf), 6) AS avg_idf FROM (SELECT term, max(idf) AS idf FROM ix GROUP BY term)")
R.on("bm25_index", "documents", lambda d: RT.bm25_index(d).select("doc_id", "term", "tf", "df", "len", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl")),
     f"WITH {BASE} SELECT doc_id, term, tf, df, len, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl FROM ix")
R.add("fts_topk", lambda s, d: RT.fts_topk(asked(s, d), load(s, d, "documents")), f"WITH {BASE}, {_fts('r', _Q, 15)} SELECT query_id, doc_id, matched, tf, rank FROM r")
R.add("sparse_dispatch", lambda s, d: RT.sparse_topk(asked(s, d), load(s, d, "documents")).unionByName(RT.sparse_topk(asked(s, d), load(s, d, "documents"), engine="bm25")),
      f"WITH {BASE}, {_fts('a', _Q, 15)}, {_bm25('b', _Q, 15)} SELECT query_id, doc_id, rank, 'fts' AS sparse_engine FROM a UNION ALL SELECT query_id, doc_id, rank, 'bm25' FROM b")
R.add("retriever_overlap", lambda s, d: RT.overlap(RT.bm25_topk(asked(s, d), load(s, d, "documents"), 200), RT.fts_topk(asked(s, d), load(s, d, "documents"), 200)),
      f"WITH {BASE}, {_fts('b', _Q, 200)}, {_bm25('a', _Q, 200)} SELECT query_id, count(*) FILTER (WHERE a.rank <= 15) AS recalled, count(*) AS shared FROM a JOIN b USING (query_id, doc_id) GROUP BY query_id")
R.on("corpus_profile", "documents", lambda d: d.select("doc_id", F.length("text").alias("c"), T.tokenize(F.col("text")).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("avg_chars"), F.round(F.avg(F.size("t")), 6).alias("avg_tokens")).crossJoin(RT.postings(d).agg(F.count_distinct("term").alias("terms"))),
     f"WITH {BASE} SELECT count(*) AS n, round(avg(length(text)), 6) AS avg_chars, round(avg(len({TOK.format('text')})), 6) AS avg_tokens, (SELECT count(DISTINCT term) FROM tf) AS terms FROM documents")


def lists(s: SparkSession, d: str, queries: DataFrame, k: int = 15, per: int = 2) -> DataFrame:
    """(query_id, list_id, rank, doc_id): dense lists of an item's sub-queries, `per` at most, then sparse ones; query_id is the item's."""
    docs = load(s, d, "documents")
    vec = V.embed_text(docs, "doc_id", "text").withColumnRenamed("doc_id", "id")
    dense = V.dense_topk(V.embed_text(queries, "query_id", "text"), vec, k).select("query_id", F.col("id").alias("doc_id"), "rank", F.lit(0).alias("kind"))
    sparse = RT.bm25_topk(queries, docs, k).select("query_id", "doc_id", "rank", F.lit(per).alias("kind"))
    both = dense.unionByName(sparse)
    return both.select(F.floor(F.col("query_id") / per).alias("query_id"), (F.col("kind") + F.col("query_id") % per).alias("list_id"), "rank", "doc_id")


_LISTS = f"""{BASE}, {_SUB}, {_embed('de', 'documents', 'doc_id')}, {_embed('qe', 'sub', 'query_id')}, {_dense('dn', 'qe', '(SELECT doc_id AS id, vec FROM de)', 15, 0.2)}, {_bm25('sp', 'sub', 15)},
lists AS (SELECT query_id // 2 AS query_id, query_id % 2 AS list_id, rank, id AS doc_id FROM dn UNION ALL SELECT query_id // 2, 2 + query_id % 2, rank, doc_id FROM sp),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 12) AS rrf, min(list_id * 1000 + rank) AS f FROM lists GROUP BY ALL))"""
_COVER = "list_filter(list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda x: x <> ''), lambda x: contains(lower(text), x))"
_RERANK = f"""{_LISTS}, rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY "cross" DESC, fused_rank) AS rank FROM (SELECT query_id, doc_id, rrf, fused_rank, round(1 / (1 + exp(-(8 * least(1.0, 0.7 * len(h) / n + 0.3 * CASE WHEN len(h) > 0 THEN 1 - list_min(list_transform(h, lambda x: instr(lower(text), x) - 1)) / greatest(1, length(text)) ELSE 0 END) - 4))), 9) AS "cross"
FROM (SELECT query_id, doc_id, rrf, rank AS fused_rank, d.text, b.text AS q, len(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda x: x <> '')) AS n, {_COVER.replace('lower(q)', 'lower(b.text)').replace('lower(text)', 'lower(d.text)')} AS h FROM fused JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id))) WHERE rank <= 5)"""


def fused(s: SparkSession, d: str) -> DataFrame:
    return RT.rrf_fuse(lists(s, d, subqueries(s, d)))


def reranked(s: SparkSession, d: str) -> DataFrame:
    return RT.rerank_topk(fused(s, d), asked(s, d), load(s, d, "documents"))


def hybrid(s: SparkSession, d: str) -> DataFrame:
    """Sub-queries, dense and sparse lists, fusion, reranking and gate, for all items in one plan."""
    docs = load(s, d, "documents").select("doc_id", "source")
    ranked = stored(reranked(s, d))
    return ranked.join(RT.crag_gate(asked(s, d), ranked), "query_id").join(docs, "doc_id").select("query_id", "rank", "doc_id", "source", F.round("cross", 6).alias("cross"), "path_used")


R.add("multi_query_lists", lambda s, d: lists(s, d, subqueries(s, d)), f"WITH {_LISTS} SELECT query_id, list_id, rank, doc_id FROM lists")
R.add("rrf_fuse", lambda s, d: fused(s, d).select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"), "rank"), f"WITH {_LISTS} SELECT query_id, doc_id, round(rrf, 6) AS rrf, rank FROM fused")
R.add("rerank_topk", lambda s, d: reranked(s, d).select("query_id", "doc_id", F.round("cross", 6).alias("cross"), "rank"), f'WITH {_RERANK} SELECT query_id, doc_id, round("cross", 6) AS "cross", rank FROM rr')
R.add("rerank_fallback", lambda s, d: RT.rerank_fallback(fused(s, d).withColumn("cross", F.when(F.col("doc_id") % 3 == 0, 0.6)).withColumn("similarity", F.when(F.col("doc_id") % 2 == 0, F.col("rrf") * 10))).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank"),
      f"WITH {_LISTS} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 0.6 WHEN doc_id % 2 = 0 THEN rrf * 10 ELSE 0.75 END AS score FROM fused WHERE rank <= 5)")
R.add("crag_gate", lambda s, d: RT.crag_gate(asked(s, d), reranked(s, d)).select("query_id", F.round("best", 6).alias("best"), "needs_web_fallback", "path_used"),
      f"""WITH {_RERANK} SELECT item_id AS query_id, round(coalesce(m, 0), 6) AS best, coalesce(m, 0) < 0.5 AS needs_web_fallback, CASE WHEN coalesce(m, 0) < 0.5 THEN 'web' ELSE 'vector' END AS path_used FROM benchmark LEFT JOIN (SELECT query_id, max("cross") AS m FROM rr GROUP BY 1) ON query_id = item_id""")
R.add("context_filter", lambda s, d: RT.context_filter(asked(s, d), reranked(s, d)),
      f"""WITH {_RERANK} SELECT item_id AS query_id, coalesce(n, 0) AS n, coalesce(m >= 0.5, false) AS grounded FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS n, max("cross") AS m FROM rr WHERE "cross" >= 0.2 GROUP BY 1) ON query_id = item_id""")


def with_text(s: SparkSession, d: str, ranked: DataFrame) -> DataFrame:
    return RT.with_text(ranked, load(s, d, "documents").select("doc_id", "text", "source"))


def expanded(s: SparkSession, d: str) -> DataFrame:
    ranked = with_text(s, d, RT.bm25_topk(asked(s, d), load(s, d, "documents")))
    chunks = ranked.select("query_id", F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 10).alias("parent_id"), "rank", "text")
    parents = load(s, d, "documents").where("doc_id % 10 = 0 AND n_chars > 1000").select(F.floor(F.col("doc_id") / 10).alias("parent_id"), "text")
    return RT.expand_to_parents(chunks, parents)


R.add("expand_to_parents", lambda s, d: expanded(s, d).select("query_id", "chunk_id", "rank", F.md5("text").alias("text_md5")),
      f"""WITH {BASE}, {_bm25('r', _Q, 15)}, p AS (SELECT doc_id // 10 AS parent_id, text AS pt FROM documents WHERE doc_id % 10 = 0 AND n_chars > 1000)
      SELECT query_id, chunk_id, rank, md5(t) AS text_md5 FROM (SELECT query_id, doc_id AS chunk_id, rank, coalesce(pt, text) AS t, row_number() OVER (PARTITION BY query_id, CASE WHEN pt IS NULL THEN 'c' || doc_id ELSE 'p' || parent_id END ORDER BY rank) AS i FROM r JOIN documents USING (doc_id) LEFT JOIN p ON parent_id = doc_id // 10) WHERE i = 1""")
R.add("build_context", lambda s, d: RT.build_context(with_text(s, d, reranked(s, d))).select("query_id", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("n")),
      f"WITH {_RERANK} SELECT query_id, md5(c) AS context_md5, length(c) AS n FROM (SELECT query_id, string_agg('[Source: ' || source || ' (' || doc_id || ')]' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS c FROM rr JOIN documents USING (doc_id) GROUP BY query_id)")
R.add("source_list", lambda s, d: RT.source_list(with_text(s, d, reranked(s, d))),
      f"WITH {_RERANK} SELECT query_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, array_to_string(list_sort(list_distinct(list(doc_id))), ',') AS doc_ids FROM rr JOIN documents USING (doc_id) GROUP BY query_id")
R.add("hybrid_retrieve", hybrid,
      f"""WITH {_RERANK} SELECT query_id, rank, doc_id, source, round("cross", 6) AS "cross", CASE WHEN max("cross") OVER (PARTITION BY query_id) < 0.5 THEN 'web' ELSE 'vector' END AS path_used FROM rr JOIN documents USING (doc_id)""")


def normalized(s: SparkSession, d: str, per: int = 3) -> DataFrame:
    """An item's sub-queries: its text, then its distinct sentences; query_id is item_id * per and the place."""
    subs = chunking.normalize_subqueries(F.col("text"), F.split("text", r"[.!?]\s+"), per)
    return load(s, d, "benchmark").select("item_id", F.posexplode(subs).alias("j", "text")).select((F.col("item_id") * per + F.col("j")).alias("query_id"), "text")


def hybrid_expanded(s: SparkSession, d: str) -> DataFrame:
    """The whole retrieval of all items: normalised sub-queries, dense and sparse lists, fusion, reranking, gate, parents' texts.

    Documents stand for chunks; every tenth, if long enough, is the parent of the nine after it.
    """
    docs = load(s, d, "documents")
    found = stored(RT.rerank_topk(RT.rrf_fuse(lists(s, d, normalized(s, d), per=3)), asked(s, d), docs))
    chunks = with_text(s, d, found).select("query_id", F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 10).alias("parent_id"), "rank", "text")
    parents = docs.where("doc_id % 10 = 0 AND n_chars > 1000").select(F.floor(F.col("doc_id") / 10).alias("parent_id"), "text")
    return RT.expand_to_parents(chunks, parents).join(RT.crag_gate(asked(s, d), found), "query_id").select("query_id", "chunk_id", "rank", F.md5("text").alias("text_md5"), "path_used")


_SUB3 = """sub AS (SELECT item_id * 3 + row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS query_id, substr(x, 1, 500) AS text FROM (SELECT item_id, x, min(i) AS i FROM (SELECT item_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
    SELECT item_id, list_prepend(text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]\\s+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS l FROM benchmark)) GROUP BY item_id, x) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i) <= 3)"""
_RERANK3 = _RERANK.replace(_SUB, _SUB3).replace("query_id // 2", "query_id // 3").replace("query_id % 2 AS", "query_id % 3 AS").replace("2 + query_id % 2", "3 + query_id % 3")
R.add("hybrid_expanded", hybrid_expanded,
      f"""WITH {_RERANK3}, p AS (SELECT doc_id // 10 AS parent_id, text AS pt FROM documents WHERE doc_id % 10 = 0 AND n_chars > 1000),
      b AS (SELECT query_id, max("cross") AS m FROM rr GROUP BY 1)
      SELECT query_id, chunk_id, rank, md5(t) AS text_md5, CASE WHEN m < 0.5 THEN 'web' ELSE 'vector' END AS path_used FROM (SELECT query_id, doc_id AS chunk_id, rank, coalesce(pt, text) AS t, row_number() OVER (PARTITION BY query_id, CASE WHEN pt IS NULL THEN 'c' || doc_id ELSE 'p' || parent_id END ORDER BY rank) AS i FROM rr JOIN documents USING (doc_id) LEFT JOIN p ON parent_id = doc_id // 10) JOIN b USING (query_id) WHERE i = 1""")


def partly(s: SparkSession, d: str) -> DataFrame:
    """Reranked rows, as if a seventh of the items had found nothing."""
    return reranked(s, d).where("query_id % 7 <> 3")


_PARTLY = "(SELECT * FROM rr WHERE query_id % 7 <> 3)"
R.add("context_or_sentinel", lambda s, d: RT.build_context(with_text(s, d, partly(s, d)), RT.LONG_CONTEXT, asked(s, d)).select("query_id", F.md5("context").alias("context_md5")),
      f"WITH {_RERANK} SELECT item_id AS query_id, md5(coalesce(c, 'No relevant context found.')) AS context_md5 FROM benchmark LEFT JOIN (SELECT query_id, substr(string_agg('[Source: ' || source || ' (' || doc_id || ')]' || chr(10) || text, chr(10) || chr(10) ORDER BY rank), 1, 3500) AS c FROM {_PARTLY} JOIN documents USING (doc_id) GROUP BY query_id) ON query_id = item_id")


def from_web(s: SparkSession, d: str) -> DataFrame:
    """Pages as web results of the items: page_id tells the item and the place."""
    n = load(s, d, "benchmark").agg(F.max("item_id").alias("n"))
    pages = load(s, d, "pages").crossJoin(F.broadcast(n)).where("page_id % (n + 9) <= n")
    return pages.select((F.col("page_id") % (F.col("n") + 9)).alias("query_id"), F.col("page_id").alias("rank"), T.html_title(F.col("html")).alias("title"), F.substring("html", 1, 80).alias("snippet"), "url")


R.add("web_context", lambda s, d: RT.web_context(from_web(s, d).withColumn("title", F.concat(F.lit("page "), "rank")), RT.SHORT_CONTEXT, asked(s, d)).select("query_id", F.md5("context").alias("context_md5")),
      "SELECT item_id AS query_id, md5(coalesce(c, '')) AS context_md5 FROM benchmark LEFT JOIN (SELECT page_id % (n + 9) AS query_id, substr(string_agg('[WEB]: page ' || page_id || chr(10) || substr(html, 1, 80) || chr(10) || '(' || url || ')', chr(10) || chr(10) ORDER BY page_id), 1, 2500) AS c FROM pages, (SELECT max(item_id) AS n FROM benchmark) GROUP BY 1) ON query_id = item_id")
R.add("citations", lambda s, d: RT.citations(with_text(s, d, partly(s, d)).withColumn("url", F.concat(F.lit("doc:"), "doc_id")).withColumn("similarity", F.when(F.col("doc_id") % 2 == 0, F.col("rrf"))).withColumn("cross", F.when(F.col("doc_id") % 3 == 0, F.col("cross"))), asked(s, d))
      .select("query_id", F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["name"], c["url"], F.format_string("%.6f", c["score"]), c["document_id"].cast("string"))), ";").alias("cited"), F.array_join(F.transform("parent_ids", lambda x: x.cast("string")), ",").alias("parents")),
      f"""WITH {_RERANK} SELECT item_id AS query_id, coalesce(cited, '') AS cited, coalesce(parents, '') AS parents FROM benchmark LEFT JOIN (SELECT query_id, string_agg(source || '|doc:' || doc_id || '|' || printf('%.6f', CASE WHEN doc_id % 3 = 0 THEN "cross" WHEN doc_id % 2 = 0 THEN rrf ELSE 0.0 END) || '|' || doc_id, ';' ORDER BY rank) AS cited, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS parents FROM {_PARTLY} JOIN documents USING (doc_id) GROUP BY 1) ON query_id = item_id""")
R.add("mrr_at_k", lambda s, d: mrr(vectors(s, d)),
      f"WITH {_VEC}, {_dense('r', 'vq', 'v', 10, -1, 'query_id <> id')} SELECT round(avg(coalesce(1 / f, 0)), 6) AS mrr, count(*) AS queries FROM vq LEFT JOIN (SELECT query_id, min(rank) AS f FROM r JOIN v USING (id) JOIN vq USING (query_id) WHERE label = q_label GROUP BY 1) USING (query_id)")


def mrr(v: DataFrame, k: int = 10) -> DataFrame:
    """Mean reciprocal rank of the first neighbour with the query's label among the k nearest; 0 when there is none."""
    found = V.dense_topk(probes(v), v, k, -1.0, other_only=True)
    labels = v.select("id", "label")
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("q_label"))
    first = found.join(labels, "id").join(own, "query_id").where("label = q_label").groupBy("query_id").agg(F.min("rank").alias("first"))
    return probes(v).join(first, "query_id", "left").agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count(F.lit(1)).alias("queries"))


R.add("context_precision", lambda s, d: reranked(s, d).groupBy("query_id").agg(F.round(F.avg(F.when(F.col("cross") > 0.5, 1.0).otherwise(0.0)), 6).alias("precision")),
      f'WITH {_RERANK} SELECT query_id, round(avg(CASE WHEN "cross" > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS "precision" FROM rr GROUP BY 1')


R.add("context_precision_all", lambda s, d: E.context_precision(asked(s, d), partly(s, d), 0.4).select("query_id", F.round("precision", 6).alias("precision")),
      f'WITH {_RERANK} SELECT item_id AS query_id, coalesce(p, 0.0) AS "precision" FROM benchmark LEFT JOIN (SELECT query_id, round(avg(CASE WHEN "cross" > 0.4 THEN 1.0 ELSE 0.0 END), 6) AS p FROM {_PARTLY} GROUP BY 1) ON query_id = item_id')
R.add("context_recall_prefix", lambda s, d: E.prefix_recall(asked(s, d).withColumnRenamed("text", "truth"), with_text(s, d, partly(s, d)), 30),
      f"WITH {_RERANK} SELECT item_id AS query_id, max(CASE WHEN contains(lower(coalesce(d.text, '')), lower(substr(b.text, 1, 30))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall FROM benchmark b LEFT JOIN {_PARTLY} r ON query_id = item_id LEFT JOIN documents d USING (doc_id) GROUP BY 1")


def recall(s: SparkSession, d: str) -> DataFrame:
    """Share of an item's distinct tokens that stand in the texts of its best documents."""
    words = asked(s, d).select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("w"))
    texts = RT.bm25_topk(asked(s, d), load(s, d, "documents"), 5).join(load(s, d, "documents").select("doc_id", F.lower("text").alias("text")), "doc_id")
    return words.join(texts, "query_id", "left").groupBy("query_id", "w").agg(F.max(F.coalesce(F.contains("text", "w"), F.lit(False)).cast("int")).alias("hit")).groupBy("query_id").agg(F.round(F.avg("hit"), 6).alias("recall"))


R.add("context_recall", recall,
      f"WITH {BASE}, {_bm25('r', _Q, 5)} SELECT query_id, round(avg(hit), 6) AS recall FROM (SELECT query_id, w, max(CASE WHEN contains(t, w) THEN 1 ELSE 0 END) AS hit FROM (SELECT DISTINCT item_id AS query_id, unnest({TOK.format('text')}) AS w FROM benchmark) LEFT JOIN (SELECT query_id, lower(text) AS t FROM r JOIN documents USING (doc_id)) USING (query_id) GROUP BY ALL) GROUP BY 1")
