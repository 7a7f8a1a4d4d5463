"""Cache, sync, evaluation, sources and streams on the tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import cache as C
from corpusloom.operators import evaluate as E
from corpusloom.operators import sync as S
from corpusloom.operators import vectors as V
from corpusloom.sources import files
from corpusloom.sources.workspace import stored
from corpusloom.streaming import jobs

from .base import AS_OF, LINES_SQL, Registry, lines, load
from .retrieval_queries import BASE, TOK, _dense, vectors

R = Registry()
_AT = AS_OF.replace("timestamp ", "") + "::TIMESTAMP"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_HASH = f"sha256(lower({_STRIP.format('text')}))"


def messages(s: SparkSession, d: str) -> DataFrame:
    """Users' messages with hash; a cached answer of a conversation lives for as many days as its id, from the first of the month."""
    m = load(s, d, "conversations").where("role = 'user'").withColumn("query_hash", T.query_hash(F.col("text"))).withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    return m.withColumn("expires_at", F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(CAST(conv_id AS INT))"))


def entries(s: SparkSession, d: str) -> DataFrame:
    """Each conversation's first question as a cache entry."""
    return messages(s, d).groupBy("conv_id").agg(F.min_by(F.struct("query_id", "query_hash", "text", "expires_at"), "turn").alias("e")).select("conv_id", F.col("e.query_id").alias("entry_id"), "e.query_hash", "e.text", "e.expires_at")


_MSG = f"m AS (SELECT conv_id, turn, text, conv_id * 1000 + turn AS query_id, {_HASH} AS query_hash, TIMESTAMP '2024-01-01' + to_days(conv_id::INT) AS expires_at FROM conversations WHERE role = 'user'), e AS (SELECT m.*, query_id AS entry_id FROM m JOIN (SELECT conv_id, min(turn) AS turn FROM m GROUP BY 1) USING (conv_id, turn))"
R.add("cache_lookup_exact", lambda s, d: C.lookup_exact(messages(s, d), entries(s, d), F.expr(AS_OF)).select("query_id", "hit"),
      f"WITH {_MSG} SELECT query_id, hit FROM m LEFT JOIN (SELECT query_hash, min(entry_id) AS hit FROM e WHERE expires_at > {_AT} GROUP BY 1) USING (query_hash)")


def cached_vectors(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).select("id", "vec")


_VEC = "v AS (SELECT vec_id AS id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS vec FROM (SELECT *, embedding::DOUBLE[] AS e FROM embeddings)), vq AS (SELECT id AS query_id, vec FROM v WHERE id % 100 = 0)"
R.add("cache_lookup_similar", lambda s, d: C.lookup_similar(cached_vectors(s, d).where("id % 100 = 0").withColumnRenamed("id", "query_id"), cached_vectors(s, d), 0.4).select("query_id", "nearest", F.round("sim", 6).alias("sim"), "is_hit"),
      f"WITH {_VEC}, {_dense('r', 'vq', 'v', 1, -1, 'query_id <> id')} SELECT query_id, id AS nearest, round(sim, 6) AS sim, sim >= 0.4 AS is_hit FROM r")


def tiered(s: SparkSession, d: str) -> DataFrame:
    vec = V.embed_text(messages(s, d), "query_id", "text")
    kept = entries(s, d).join(vec.withColumnRenamed("query_id", "entry_id"), "entry_id", "left")
    return C.lookup_tiered(messages(s, d).join(vec, "query_id", "left"), kept, F.expr(AS_OF), ("worthless",), 0.9)


_TIER = f"""{_MSG}, h AS (SELECT query_id, list(coalesce(n, 0)::DOUBLE ORDER BY dd) AS l FROM (SELECT DISTINCT query_id FROM m WHERE len({TOK.format('text')}) > 0) CROSS JOIN (SELECT unnest(range(64)) AS dd) LEFT JOIN (SELECT query_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS dd, count(*) AS n FROM (SELECT query_id, unnest({TOK.format('text')}) AS t FROM m) GROUP BY ALL) USING (query_id, dd) GROUP BY 1),
w AS (SELECT query_id, list_transform(l, lambda x: x / sqrt(list_sum(list_transform(l, lambda y: y * y)))) AS vec FROM h),
p AS (SELECT query_id, CASE WHEN contains(lower(text), 'worthless') THEN 'negative' WHEN query_hash IN (SELECT query_hash FROM e WHERE expires_at > {_AT}) THEN 'exact' END AS path FROM m)"""
R.add("cache_lookup_tiered", tiered,
      f"WITH {_TIER} SELECT query_id, coalesce(path, CASE WHEN s >= 0.9 THEN 'similar' ELSE 'miss' END) AS path FROM p LEFT JOIN (SELECT a.query_id, max(round(list_dot_product(a.vec, b.vec), 9)) AS s FROM w a, w b, e WHERE b.query_id = e.entry_id AND e.expires_at > {_AT} AND a.query_id <> b.query_id GROUP BY 1) USING (query_id)")


def snapshots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A cache of the conversations' first questions, and a batch of all questions as new answers."""
    row = lambda m, t: m.select("query_hash", F.col("text").alias("query_text"), t.alias("answer"), F.array((F.col("conv_id") % 50).alias("d"), (F.col("conv_id") % 7).alias("e")).alias("doc_ids"), F.expr("timestamp '2024-01-01 00:00:00'").alias("created_at"), "expires_at", F.col("conv_id").alias("ts"))
    old = row(entries(s, d), F.lit("old")).groupBy("query_hash").agg(F.min_by(F.struct("query_text", "answer", "doc_ids", "created_at", "expires_at"), "ts").alias("x")).select("query_hash", "x.*")
    return old, row(messages(s, d), F.concat(F.lit("new "), F.col("query_id").cast("string"))).withColumn("ts", F.col("ts") * 1000)


_OLD = f"{_MSG}, o AS (SELECT query_hash, arg_min(text, conv_id) AS query_text, min(conv_id) AS c FROM e GROUP BY 1)"
R.add("cache_upsert", lambda s, d: C.upsert(*snapshots(s, d)).select("query_hash", F.md5("query_text").alias("text_md5"), "answer"),
      f"WITH {_OLD}, b AS (SELECT query_hash, arg_max(struct_pack(t := text, a := 'new ' || query_id), struct_pack(c := conv_id, a := 'new ' || query_id)) AS x FROM m GROUP BY 1) SELECT query_hash, md5(coalesce(query_text, x.t)) AS text_md5, coalesce(x.a, 'old') AS answer FROM o FULL JOIN b USING (query_hash)")
R.add("cache_expire", lambda s, d: C.expire(entries(s, d), F.expr(AS_OF)).select("entry_id"), f"WITH {_MSG} SELECT entry_id FROM e WHERE NOT expires_at < {_AT}")
R.add("cache_invalidate", lambda s, d: C.invalidate(snapshots(s, d)[0], load(s, d, "documents").where("n_chars > 20000").select("doc_id")).select("query_hash"),
      f"WITH {_OLD}, g AS (SELECT doc_id FROM documents WHERE n_chars > 20000) SELECT query_hash FROM o WHERE c % 50 NOT IN (SELECT doc_id FROM g) AND c % 7 NOT IN (SELECT doc_id FROM g)")
R.add("lineage_join", lambda s, d: C.lineage(snapshots(s, d)[0], load(s, d, "documents").where("n_chars > 10000").select("doc_id")),
      f"WITH {_OLD}, g AS (SELECT doc_id FROM documents WHERE n_chars > 10000) SELECT query_hash FROM o WHERE c % 50 IN (SELECT doc_id FROM g) OR c % 7 IN (SELECT doc_id FROM g)")
R.add("cache_clear", lambda s, d: C.clear(entries(s, d)).agg(F.count(F.lit(1)).alias("n")), "SELECT 0::BIGINT AS n FROM (SELECT count(*) FROM conversations)")


def cleared(s: SparkSession, d: str) -> DataFrame:
    """A cache written as a snapshot, cleared, and filled anew with some: what readers of either snapshot see."""
    old, _ = snapshots(s, d)
    before = stored(old.select("query_hash", "expires_at"))
    after = stored(C.clear(before).unionByName(before.where(F.col("expires_at") > F.expr(AS_OF))))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("snapshot"), "n")
    return count(before, "before").unionByName(count(C.clear(before), "cleared")).unionByName(count(after, "after"))


R.add("cache_clear_snapshot", cleared,
      f"WITH {_OLD}, x AS (SELECT query_hash, arg_min(expires_at, conv_id) AS expires_at FROM e GROUP BY 1) SELECT 'before' AS snapshot, count(*) AS n FROM x UNION ALL SELECT 'cleared', 0 FROM (SELECT 1) UNION ALL SELECT 'after', count(*) FROM x WHERE expires_at > {_AT}")
R.on("cacheable_filter", "events", lambda d: C.cacheable(d.select("event_id", (F.col("value") > 10).alias("grounded"), (F.col("event_type") == "error").alias("bypassed"))).select("event_id"), "SELECT event_id FROM events WHERE value > 10 AND event_type <> 'error'")


def versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and a later state: some texts changed, some titles, some removed, some new."""
    docs = load(s, d, "documents").select("doc_id", F.col("source").alias("title"), "text")
    k = F.col("doc_id")
    later = docs.where(k % 11 != 0).withColumn("text", F.when(k % 7 == 0, F.concat("text", F.lit(" x"))).when(k % 13 == 0, F.lit(None)).otherwise(F.col("text"))).withColumn("title", F.when(k % 5 == 0, F.upper("title")).otherwise(F.col("title")))
    added = docs.where(k % 17 == 0).withColumn("doc_id", k + 10_000_000)
    hashed = lambda x: x.withColumn("hash", F.sha2("text", 256))
    return hashed(docs), hashed(later.unionByName(added))


_NEW = "w AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(source) ELSE source END AS title, CASE WHEN doc_id % 7 = 0 THEN text || ' x' WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id + 10000000, source, text FROM documents WHERE doc_id % 17 = 0), c AS (SELECT w.doc_id, CASE WHEN w.text IS NULL THEN 'failed' WHEN d.doc_id IS NULL THEN 'created' WHEN w.text = d.text AND w.title <> d.source THEN 'retitled' WHEN w.text = d.text THEN 'skipped' ELSE 'updated' END AS change FROM w LEFT JOIN documents d USING (doc_id))"
R.add("classify_documents", lambda s, d: S.classify(*versions(s, d)), f"WITH {_NEW} SELECT * FROM c")


def synced(s: SparkSession, d: str) -> DataFrame:
    old, new = versions(s, d)
    chunk = lambda x: lines(x).select("doc_id", "line_no", "text")
    return S.apply_sync(chunk(old), S.classify(old, new), chunk(new)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


SYNCED_SQL = f"WITH {_NEW}, z AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE change IN ('created', 'updated')) UNION ALL SELECT doc_id, text FROM w JOIN c USING (doc_id) WHERE change IN ('created', 'updated')) SELECT doc_id, count(*) AS chunks, sum(length(t))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM z) WHERE t <> '' GROUP BY 1"
R.add("apply_sync", synced, SYNCED_SQL)
R.add("retitle", lambda s, d: S.retitle(load(s, d, "documents").select("doc_id", F.col("source").alias("title")), versions(s, d)[1].select("doc_id", F.col("title").alias("new_title"))),
      f"WITH {_NEW} SELECT doc_id, coalesce(w.title, source) AS title FROM documents LEFT JOIN w USING (doc_id)")
R.add("delete_documents_cascade", lambda s, d: S.cascade_delete({"documents": load(s, d, "documents"), "chunks": lines(load(s, d, "documents")), "labels": load(s, d, "labels")}, load(s, d, "documents").where("lang = 'de'").select("doc_id"))[1],
      f"SELECT 'documents' AS table_name, count(*) AS deleted FROM documents WHERE lang = 'de' UNION ALL SELECT 'chunks', count(*) FROM ({LINES_SQL}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de') UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
R.add("soft_delete", lambda s, d: S.mutate(load(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), load(s, d, "orders").where("o_totalprice > 300000"), "o_orderkey", F.col("o_custkey") % 2 == 0, {"o_orderstatus": F.lit("D")}).select("o_orderkey", "o_orderstatus"),
      "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_custkey % 2 = 0 THEN 'D' ELSE o_orderstatus END AS o_orderstatus FROM orders")
_RATING = "CASE WHEN value > 20 THEN 'UP' WHEN value > 5 THEN 'DOWN' END"
R.on("apply_feedback_log", "events", lambda d: S.latest(d.withColumn("rating", F.expr(_RATING)), ["user_id", "event_type"], "rating", ["ts", "event_id"]), "SELECT * FROM (SELECT user_id, event_type, CASE WHEN v > 20 THEN 'UP' WHEN v > 5 THEN 'DOWN' END AS rating FROM (SELECT user_id, event_type, arg_max(value, struct_pack(t := ts, e := event_id)) AS v FROM events GROUP BY ALL)) WHERE rating IS NOT NULL")


def claimed(s: SparkSession, d: str) -> DataFrame:
    """Customers of one segment are guests; their account is the customer before them."""
    guests = load(s, d, "customer").where("c_mktsegment = 'BUILDING' AND c_custkey > 0").select(F.col("c_custkey").alias("guest"), (F.col("c_custkey") - 1).alias("account"))
    return S.claim(load(s, d, "orders"), guests, "o_custkey", "o_orderpriority", "o_orderkey").select("owner", "o_orderpriority", "o_orderkey")


R.add("claim_reparent", claimed,
      "SELECT owner, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY owner, o_orderpriority ORDER BY acc DESC, o_orderkey) AS i FROM (SELECT o_orderkey, o_orderpriority, c_custkey IS NULL AS acc, CASE WHEN c_custkey IS NULL THEN o_custkey ELSE o_custkey - 1 END AS owner FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 0) ON c_custkey = o_custkey)) WHERE i = 1")


def jobs_of(d: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "QUEUED").when(F.col("event_type") == "click", "RUNNING").when(F.col("event_type") == "error", "FAILED").otherwise("DONE")
    ts = F.col("ts").cast("timestamp")
    return d.select(F.col("event_id").alias("id"), F.col("props").alias("url"), status.alias("status"), (F.col("user_id") % 5).alias("attempts"), ts.alias("started_at"), ts.alias("finished_at"))


R.on("job_reconcile", "events", lambda d: S.reconcile_jobs(jobs_of(d), F.expr(AS_OF)).select("id", "status"),
     f"SELECT id, status FROM (SELECT *, row_number() OVER (PARTITION BY props, status = 'QUEUED' ORDER BY id) AS i FROM (SELECT event_id AS id, props, CASE WHEN event_type = 'view' THEN 'QUEUED' WHEN event_type = 'click' AND ts < {_AT} - INTERVAL 10 MINUTE AND user_id % 5 < 3 THEN 'QUEUED' WHEN event_type = 'click' AND ts < {_AT} - INTERVAL 10 MINUTE THEN 'FAILED' WHEN event_type = 'click' THEN 'RUNNING' WHEN event_type = 'error' THEN 'FAILED' ELSE 'DONE' END AS status FROM events WHERE NOT (event_type NOT IN ('view', 'click') AND ts < {_AT} - INTERVAL 24 HOUR))) WHERE status <> 'QUEUED' OR i = 1")
R.on("backfill_parent_key", "documents", lambda d: d.groupBy(F.coalesce(F.when(F.col("n_chars") > 500, F.col("source")), F.lit("legacy")).alias("parent")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN n_chars > 500 THEN source ELSE 'legacy' END AS parent, count(*) AS n FROM documents GROUP BY 1")
R.on("quality_gate", "labels", lambda d: E.quality_gate(d.agg(F.avg("quality").alias("precision"), (5 - F.avg("toxic") * 4).alias("faithfulness"), (5 - F.avg(1 - F.col("quality")) * 4).alias("relevance")).unpivot([], ["precision", "faithfulness", "relevance"], "metric", "mean")).select("metric", F.round("mean", 6).alias("mean"), "passed"),
     "WITH m AS (SELECT 'precision' AS metric, avg(quality) AS mean, 0.75 AS least FROM labels UNION ALL SELECT 'faithfulness', 5 - avg(toxic) * 4, 3.5 FROM labels UNION ALL SELECT 'relevance', 5 - avg(1 - quality) * 4, 4.0 FROM labels) SELECT metric, round(mean, 6) AS mean, mean >= least AS passed FROM m UNION ALL SELECT 'overall', NULL, bool_and(mean >= least) FROM m")
R.on("mine_hard_negatives", "documents", E.hard_negatives,
     f"""WITH {BASE}, q AS (SELECT doc_id AS query_id, substr(coalesce(list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 15)[1], text), 1, 60) AS text FROM documents),
     r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) AS score FROM (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format('text')}) AS term FROM q) GROUP BY ALL) JOIN ix USING (term) GROUP BY ALL) WHERE score > 0) WHERE rank <= 10),
     b AS (SELECT query_id, arg_min(doc_id, rank) AS found FROM r WHERE doc_id <> query_id GROUP BY 1), p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
     SELECT p.doc_id, coalesce(found, o.doc_id) AS negative, found IS NOT NULL AS mined FROM p JOIN p o ON o.i = (p.i + 7) % p.n LEFT JOIN b ON query_id = p.doc_id""")
R.on("keyword_hit_rate", "conversations", lambda d: d.where("role = 'assistant'").agg(F.round(F.avg(T.contains_any(F.col("text"), ("the", "der", "les")).cast("double")), 6).alias("rate")), "SELECT round(avg(CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'der') OR contains(lower(text), 'les') THEN 1.0 ELSE 0.0 END), 6) AS rate FROM conversations WHERE role = 'assistant'")
R.on("testset_rows", "conversations", lambda d: _testset(d),
     "SELECT conv_id, turn, q AS question, a AS answer FROM (SELECT conv_id, turn, " + _STRIP.format("text") + " AS a, " + _STRIP.format("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)") + " AS q, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS pr FROM conversations) WHERE role = 'assistant' AND pr = 'user' AND a <> '' AND q <> ''")


def _testset(conv: DataFrame) -> DataFrame:
    """Questions with the answer right after them, written as labelled text and parsed back."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    raw = conv.withColumn("q", F.lag("text").over(w)).withColumn("pr", F.lag("role").over(w)).where("role = 'assistant' AND pr = 'user'")
    q, a = E.question_answer(F.concat(F.lit("QUESTION: "), F.col("q"), F.lit("\nANSWER: "), F.col("text")))
    return raw.select("conv_id", "turn", q.alias("question"), a.alias("answer")).where("question IS NOT NULL AND answer IS NOT NULL")




def _numbered(conv: DataFrame) -> DataFrame:
    """The pairs with ids q0001, q0002 and so on in their order, and the lineage of each."""
    placed = files.with_place(_testset(conv), ["conv_id", "turn"], "i")
    return placed.select(F.concat(F.lit("q"), F.lpad((F.col("i") + 1).cast("string"), 4, "0")).alias("id"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("lineage"), F.md5("question").alias("question_md5"))


R.on("testset_ids", "conversations", _numbered,
     "SELECT 'q' || lpad(row_number() OVER (ORDER BY conv_id, turn)::VARCHAR, 4, '0') AS id, conv_id || '/' || turn AS lineage, md5(q) AS question_md5 FROM (SELECT conv_id, turn, " + _STRIP.format("text") + " AS a, " + _STRIP.format("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)") + " AS q, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS pr FROM conversations) WHERE role = 'assistant' AND pr = 'user' AND a <> '' AND q <> ''")
R.on("similarity_order_check", "embeddings", lambda d: d.select("vec_id", V.norm(F.col("embedding")).alias("x")).groupBy((F.round("x", 3) == 1).alias("unit")).agg(F.count(F.lit(1)).alias("n")), "SELECT round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 3) = 1 AS \"unit\", count(*) AS n FROM embeddings GROUP BY 1")
R.add("write_embeddings", lambda s, d: files.with_global_index(lines(load(s, d, "documents")), "doc_id", "line_no").select("doc_id", "line_no", "global_index"),
      f"SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS global_index FROM ({LINES_SQL})")
R.add("scan_corpus", lambda s, d: files.scan_corpus(s, f"{d}/documents.parquet", ("doc_id", "lang", "source", "n_chars")), "SELECT doc_id, lang, source, n_chars FROM documents")
R.add("publish_reconcile", lambda s, d: files.reconcile({"documents": load(s, d, "documents"), "labels": load(s, d, "labels")}, {"documents": load(s, d, "documents"), "labels": load(s, d, "labels").where("toxic = 0")}),
      "SELECT 'documents' AS table_name, count(*) AS source_rows, count(*) AS target_rows, 'OK' AS state FROM documents UNION ALL SELECT 'labels', count(*), count(*) FILTER (WHERE toxic = 0), CASE WHEN count(*) = count(*) FILTER (WHERE toxic = 0) THEN 'OK' ELSE 'MISMATCH' END FROM labels")


def manifest(s: SparkSession, d: str) -> DataFrame:
    """Pages as manifest lines in all forms, written and parsed back."""
    k = F.col("page_id") % 4
    line = F.when(k == 0, F.col("url")).when(k == 1, F.to_json(F.struct("url", F.col("page_id").cast("string").alias("title")))).when(k == 2, F.to_json(F.struct(F.col("url").alias("pdf")))).otherwise(F.concat(F.lit("# "), F.col("url")))
    return load(s, d, "pages").select("page_id", files.parse_manifest_lines(line).alias("e")).where("e IS NOT NULL").select("page_id", "e.kind", "e.value", "e.title")


R.add("parse_batch_manifest", manifest, "SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 'pdf' ELSE 'url' END AS kind, url AS value, CASE WHEN page_id % 4 = 1 THEN page_id::VARCHAR END AS title FROM pages WHERE page_id % 4 <> 3")
R.on("rate_limit_audit", "events", lambda d: jobs.rate_limit_audit(d, "user_id", 3, 86400.0))


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    df = jobs.follow(s, f"{d}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


R.add("stream_daily_counts", lambda s, d: jobs.drain(jobs.daily_counts(_stream(s, d, "events"), F.col("event_type") == "view"), "complete"), "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")


def turns_arriving(s: SparkSession, d: str) -> DataFrame:
    """Conversations as a stream in three micro-batches, each with some turns of all conversations."""
    return jobs.arrive(load(s, d, "conversations"), F.least(F.floor(F.col("turn") / 3), F.lit(2)), 3)


def events_arriving(s: SparkSession, d: str, parts: int = 4) -> DataFrame:
    """Events as a stream of micro-batches, each row up to 21 hours late; a last row without id moves the watermark past all."""
    e = load(s, d, "events").select("event_id", "user_id", "props", F.col("ts").cast("timestamp").alias("ts"))
    late = F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(75_600))
    part = F.greatest(F.lit(0), F.least(F.floor(late / (31 * 86_400 / parts)), F.lit(parts - 1)))
    mark = s.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in (("event_id", "long"), ("user_id", "long"), ("props", "string"))], F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(parts).alias("part"))
    rows = e.withColumn("part", part).unionByName(mark)
    return jobs.arrive(rows, F.col("part"), parts + 1).drop("part")


R.add("stream_memory", lambda s, d: jobs.drain(jobs.memory(turns_arriving(s, d)), "update").where("turns IS NOT NULL").groupBy("conv_id").agg(F.max_by("turns", "batch").alias("turns")),
      "SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE i <= 8 GROUP BY conv_id")
_CHATS = "conversations WHERE role IN ('user', 'assistant')"
R.add("stream_evicted_pairs", lambda s, d: jobs.drain(jobs.memory(turns_arriving(s, d).where("role IN ('user', 'assistant')"), 4), "update").where("evicted IS NOT NULL").select("conv_id", F.col("evicted").alias("turn"), "user_text", "answer"),
      f"SELECT conv_id, turn, user_text, substr(text, 1, 200) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_text FROM {_CHATS}) WHERE i > 4 AND role = 'assistant'")
R.add("stream_memory_context", lambda s, d: jobs.drain(jobs.memory(turns_arriving(s, d).where("role IN ('user', 'assistant')"), 4), "update").where("turns IS NOT NULL").groupBy("conv_id").agg(F.max_by("context", "batch").alias("context")),
      f"SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM {_CHATS}) WHERE i <= 4 GROUP BY conv_id")
R.add("stream_cache", lambda s, d: jobs.drain(jobs.cache_answers(events_arriving(s, d), "props")).select("query_hash", "event_id", "entry_id", "hit"),
      """WITH RECURSIVE a AS (SELECT props AS h, min(struct_pack(t := ts, i := event_id)) AS m FROM events GROUP BY props
      UNION ALL SELECT a.h, min(struct_pack(t := e.ts, i := e.event_id)) AS m FROM a JOIN events e ON e.props = a.h AND e.ts >= a.m.t + INTERVAL 7 DAY GROUP BY a.h, a.m)
      SELECT e.props AS query_hash, e.event_id, max(m).i AS entry_id, max(m).i <> e.event_id AS hit FROM events e JOIN a ON a.h = e.props AND a.m <= struct_pack(t := e.ts, i := e.event_id) GROUP BY e.props, e.event_id""")
R.add("rate_limit_stream", lambda s, d: jobs.drain(jobs.rate_limit_stream(events_arriving(s, d), "user_id", 3, 86400.0)).select("event_id", "admitted", "remaining", "reset_s"))
R.add("pairing_stream", lambda s, d: jobs.drain(jobs.pairs(_stream(s, d, "events").where("event_type = 'view'").select("event_id", "user_id", "ts"), _stream(s, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts"))).where("answer_id IS NOT NULL").groupBy("event_id").agg(F.min_by("answer_id", "answer_ts").alias("answer_id")),
      "SELECT q.event_id, arg_min(a.event_id, a.ts) AS answer_id FROM events q JOIN events a ON q.user_id = a.user_id AND a.ts > q.ts AND a.ts <= q.ts + INTERVAL 12 HOUR WHERE q.event_type = 'view' AND a.event_type = 'purchase' GROUP BY 1")
