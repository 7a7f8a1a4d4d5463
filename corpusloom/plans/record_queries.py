"""Records: stored evaluation results, cached payloads, labels of amounts, states of rows, parents, checks of vector spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import analytics as A
from corpusloom.operators import cache as C
from corpusloom.operators import evaluate as E
from corpusloom.operators import retrieval as RT
from corpusloom.operators import sync as S
from corpusloom.operators import vectors as V
from corpusloom.streaming import jobs

from .base import Registry, load
from .retrieval_queries import _Q, BASE, _bm25, asked

R = Registry()


def eval_results(s: SparkSession, d: str) -> DataFrame:
    """Results of a benchmark run, written as JSON records and read back."""
    top = RT.bm25_topk(asked(s, d), load(s, d, "documents"), 5)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",")
    path = f"{jobs.work_dir(s)}/results"
    E.write_results(top.groupBy("query_id").agg(F.lit("bm25").alias("engine"), F.count(F.lit(1)).alias("chunks_retrieved"), ids.alias("doc_ids")), path)
    return s.read.schema("query_id long, engine string, chunks_retrieved long, doc_ids string").json(path)


R.add("write_eval_results", eval_results,
      f"WITH {BASE}, {_bm25('r', _Q, 5)} SELECT query_id, 'bm25' AS engine, count(*) AS chunks_retrieved, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids FROM r GROUP BY query_id")


def payloads(d: DataFrame) -> DataFrame:
    """Payloads of all kinds: no object, a broken text, an answer of another kind, and sources that aren't objects."""
    kind = F.col("event_id") % 5
    name = F.col("event_type")
    raw = F.when(kind == 0, F.concat(F.lit('"'), name, F.lit('"'))).when(kind == 1, F.concat(F.lit('{"answer": "'), name, F.lit('"')))
    raw = raw.when(kind == 2, F.lit('{"answer": 7, "sources": [{"name": "x"}, 5, null, "y"]}')).when(kind == 3, F.concat(F.lit('{"answer": "'), name, F.lit('", "sources": "none"}')))
    answer, sources = C.parse_payload(raw.otherwise(F.concat(F.lit('{"answer": "'), name, F.lit('", "sources": [{"name": "a"}, {"name": "b"}, 1]}'))))
    return d.select("event_id", answer.alias("answer"), F.size(sources).cast("long").alias("n_sources"))


R.on("parse_cache_payload", "events", payloads,
     "SELECT event_id, CASE WHEN event_id % 5 IN (3, 4) THEN event_type ELSE '' END AS answer, CASE event_id % 5 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 0 END::BIGINT AS n_sources FROM events")


def strict_sources(d: DataFrame) -> DataFrame:
    """Lists of sources, some with an entry that breaks the form, which empties the whole list."""
    kind = F.col("event_id") % 4
    one = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "url": "u", "score": 0.5}'))
    raw = F.when(kind == 0, F.concat(F.lit("["), one, F.lit(', {"name": "z", "url": "v", "score": 2, "documentId": "d"}]')))
    raw = raw.when(kind == 1, F.concat(F.lit("["), one, F.lit(', {"name": "z", "score": 2}]'))).when(kind == 2, F.concat(F.lit("["), one, F.lit(', {"name": "z", "url": "v", "score": "2"}]'))).otherwise(one)
    found = C.parse_sources(raw)
    return d.select("event_id", F.size(found).cast("long").alias("n"), F.array_join(F.transform(found, lambda x: x["name"]), ",").alias("names"))


R.on("parse_sources_strict", "events", strict_sources,
     "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS n, CASE WHEN event_id % 4 = 0 THEN event_type || ',z' ELSE '' END AS names FROM events")
_USD = "value * 1.00037 / power(10, event_id % 8)"
R.on("format_usd", "events", lambda d: d.select("event_id", A.usd_label(F.expr(_USD)).alias("usd")),
     f"SELECT event_id, CASE WHEN u <= 0 THEN '$0.00' WHEN u >= 1 THEN printf('$%.2f', u) WHEN u >= 0.01 THEN printf('$%.3f', u) ELSE CASE least(9, greatest(4, 2 + ceil(-log10(u))::INT)) WHEN 4 THEN printf('$%.4f', u) WHEN 5 THEN printf('$%.5f', u) WHEN 6 THEN printf('$%.6f', u) WHEN 7 THEN printf('$%.7f', u) WHEN 8 THEN printf('$%.8f', u) ELSE printf('$%.9f', u) END END AS usd FROM (SELECT event_id, {_USD} AS u FROM events)")
R.on("last_synced", "events", lambda d: d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_synced")),
     "SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_synced FROM events GROUP BY user_id")
_ROW = ("o_orderkey", "o_custkey", "o_orderstatus")


def changed(orders: DataFrame, keys: str, owner: str, name: str, value: Column) -> DataFrame:
    return S.mutate(orders.select(*_ROW, F.lit(False).alias("pinned")), orders.where(keys), "o_orderkey", F.expr(owner), {name: value}).drop("o_custkey")


R.on("restore", "orders", lambda d: changed(d, "o_totalprice > 200000", "o_orderstatus = 'F' AND o_custkey % 3 = 1", "o_orderstatus", F.lit("O")),
     "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND o_orderstatus = 'F' AND o_custkey % 3 = 1 THEN 'O' ELSE o_orderstatus END AS o_orderstatus, false AS pinned FROM orders")
R.on("pin", "orders", lambda d: changed(d, "o_orderpriority = '1-URGENT'", "o_custkey % 2 = 1", "pinned", ~F.col("pinned")),
     "SELECT o_orderkey, o_orderstatus, o_orderpriority = '1-URGENT' AND o_custkey % 2 = 1 AS pinned FROM orders")
R.on("clear_conversations", "orders", lambda d: changed(d, "true", "o_custkey = 7 AND o_orderstatus <> 'D'", "o_orderstatus", F.lit("D")),
     "SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 'D' ELSE o_orderstatus END AS o_orderstatus, false AS pinned FROM orders")


def legacy_parents(d: DataFrame) -> DataFrame:
    """Short documents have no source; they get the legacy one, and it gets a row."""
    rows = d.select("doc_id", F.when(F.col("n_chars") > 500, F.col("source")).alias("source"))
    filled, parents = S.backfill_parent(rows, rows.where("source is not null").select("source").distinct(), "source", "legacy")
    return parents.join(filled.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left")


R.on("legacy_parent", "documents", legacy_parents, "SELECT coalesce(CASE WHEN n_chars > 500 THEN source END, 'legacy') AS source, count(*) AS n FROM documents GROUP BY 1")


def ordered(d: DataFrame) -> DataFrame:
    """Each hundredth vector with itself and the three after it: the first must be nearest, the others as they come."""
    probe = d.select("vec_id", F.col("embedding").alias("other"))
    each = d.where("vec_id % 100 = 0").select(F.col("vec_id").alias("anchor_id"), F.col("embedding").alias("anchor"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
    return V.similarity_order(each.join(probe, F.col("vec_id") == F.col("anchor_id") + F.col("place")), "anchor_id", "place", "anchor", "other")


R.on("similarity_order", "embeddings", ordered,
     "SELECT anchor_id, bool_and(coalesce(sim <= before + 1e-9, true)) AS ordered FROM (SELECT *, lag(sim) OVER (PARTITION BY anchor_id ORDER BY place) AS before FROM (SELECT a.vec_id AS anchor_id, b.vec_id - a.vec_id AS place, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id AND a.vec_id + 3 WHERE a.vec_id % 100 = 0)) GROUP BY 1")
R.on("stale_vectors", "embeddings", lambda d: V.stale(d.select("vec_id", F.when(F.col("vec_id") % 10 == 3, "old").when(F.col("vec_id") % 10 != 7, "new").alias("model"), F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("vec")), "new", 64).select("vec_id"),
     "SELECT vec_id FROM embeddings WHERE vec_id % 10 IN (3, 7) OR vec_id % 11 = 0")
