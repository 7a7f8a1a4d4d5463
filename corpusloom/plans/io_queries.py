"""Round trips through files, parsed model output, and comparisons of engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluate as E
from corpusloom.operators import retrieval as RT
from corpusloom.sources import files
from corpusloom.sources.publish import Publisher
from corpusloom.sources.snapshots import Snapshots
from corpusloom.streaming import jobs

from .base import LINES_SQL, Registry, lines, load
from .retrieval_queries import _LISTS, _bm25, asked, fused
from .table_queries import _NEW as NEW_SQL
from .table_queries import SYNCED_SQL, versions

R = Registry()


def manifest(s: SparkSession, d: str) -> DataFrame:
    """Pages written as a JSON array of entries, a file each hundred, and read back."""
    folder = jobs.work_dir(s)
    pages = load(s, d, "pages").select(F.floor(F.col("page_id") / 100).alias("part"), F.struct("url", F.col("page_id").cast("string").alias("title")).alias("e"))
    pages.groupBy("part").agg(F.to_json(F.collect_list("e")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return files.scan_manifest(s, folder).select("url", "title")


R.add("scan_manifest", manifest, "SELECT url, page_id::VARCHAR AS title FROM pages")


def raw_text(s: SparkSession, d: str) -> DataFrame:
    """Documents of each source written as texts, one task and file a source, and read back whole by the folder's manifest."""
    folder = jobs.work_dir(s)
    docs = load(s, d, "documents").select("doc_id", F.regexp_replace(F.concat_ws(" ", F.col("doc_id").cast("string"), "text"), r"[\r\n]", " ").alias("value"))
    docs.select("value").write.text(folder)
    names = s.read.text(folder, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("name"))
    whole = files.scan_raw_text(s, folder, names)
    return whole.select(F.explode(T.non_empty(F.split("text", "\n"))).alias("line")).select(F.substring_index("line", " ", 1).cast("long").alias("doc_id"), F.length("line").cast("long").alias("n"))


R.add("scan_raw_text", raw_text, "SELECT doc_id, length(doc_id || ' ' || text) AS n FROM documents")


def chunks_written(s: SparkSession, d: str) -> DataFrame:
    folder = jobs.work_dir(s)
    chunks = lines(load(s, d, "documents")).select("doc_id", "line_no", "text")
    files.write_chunks(chunks, folder, "json")
    return s.read.schema(chunks.schema).json(folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


R.add("write_chunks", chunks_written, f"SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM ({LINES_SQL}) GROUP BY 1")


def loaded_once(s: SparkSession, d: str) -> DataFrame:
    """Loaded, then a second load that must not replace it, then a forced one elsewhere."""
    docs, a = load(s, d, "documents").select("doc_id", "lang"), jobs.work_dir(s)
    files.load_once(s, docs.where("lang = 'en'"), a)
    files.load_once(s, docs, a)
    b = jobs.work_dir(s)
    files.load_once(s, docs.where("lang = 'en'"), b)
    files.load_once(s, docs, b, force=True)
    count = lambda path, name: s.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("load"), "n")
    return count(a, "kept").unionByName(count(b, "forced"))


R.add("load_corpus_once", loaded_once, "SELECT 'kept' AS load, count(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 'forced', count(*) FROM documents")


def fenced() -> Column:
    """A message as a model's raw answer: JSON in a fence, bare JSON, or none."""
    raw = F.to_json(F.struct(F.col("turn").alias("score"), F.col("text").alias("answer")))
    return F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).when(F.col("turn") % 3 == 1, raw).otherwise(F.concat(F.lit("not json "), F.col("text")))


def loose(d: DataFrame) -> DataFrame:
    parsed = E.parse_json_loose(fenced(), "score int, answer string", ("score", "answer"), F.struct(F.lit(0).alias("score"), F.lit("").alias("answer")))
    return d.select("conv_id", "turn", parsed.alias("p")).select("conv_id", "turn", "p.score", F.md5("p.answer").alias("answer_md5"))


R.on("parse_json_loose", "conversations", loose,
     "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 0 ELSE turn END AS score, md5(CASE WHEN turn % 3 = 2 THEN '' ELSE text END) AS answer_md5 FROM conversations")
R.on("parse_scores", "events", lambda d: d.select("event_id", E.parse_score(F.concat(F.lit("note\nFAITHFULNESS: "), F.round("value", 2).cast("string"), F.lit(" of 5")), "FAITHFULNESS", 3.0).alias("score")),
     "SELECT event_id, CASE WHEN round(value, 2) BETWEEN 1 AND 5 THEN round(value, 2) ELSE 3.0 END AS score FROM events")
_SOURCES = "array<struct<name:string,score:double>>"


def sources(d: DataFrame) -> DataFrame:
    """Named sources of a payload; anything that isn't a list of objects counts as none."""
    pair = F.array(F.struct(F.col("event_type").alias("name"), F.col("value").alias("score")), F.struct(F.lit(None).cast("string").alias("name"), F.lit(1.0).alias("score")))
    raw = F.when(F.col("value") > 50, F.lit("[1, 2")).when(F.col("value") > 20, F.lit("{}")).otherwise(F.to_json(pair))
    listed = F.coalesce(F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, _SOURCES)), F.array().cast(_SOURCES))
    return d.select("event_id", F.size(F.filter(listed, lambda x: x["name"].isNotNull())).cast("long").alias("n"))


R.on("parse_sources", "events", sources, "SELECT event_id, CASE WHEN value > 20 THEN 0 ELSE 1 END AS n FROM events")


def side_by_side(s: SparkSession, d: str) -> DataFrame:
    """Both engines' mean rank of their first 15 documents' coverage of the query, and the difference."""
    docs = load(s, d, "documents")
    engines = {"bm25": RT.bm25_topk(asked(s, d), docs).select("query_id", "doc_id"), "hybrid": fused(s, d).where("rank <= 15").select("query_id", "doc_id")}
    means = None
    for name, found in engines.items():
        scored = RT.with_text(found.join(asked(s, d), "query_id"), docs.select("doc_id", F.col("text").alias("body")))
        hits = F.size(F.filter(F.array_distinct(T.tokenize(F.col("text"))), lambda t: F.contains(F.lower("body"), t))) / F.size(F.array_distinct(T.tokenize(F.col("text"))))
        one = scored.select("query_id", hits.alias("recall")).groupBy("query_id").agg(F.avg("recall").alias(name))
        means = one if means is None else means.join(one, "query_id")
    return means.agg(F.round(F.avg("bm25"), 6).alias("bm25"), F.round(F.avg("hybrid"), 6).alias("hybrid"), F.round(F.avg(F.col("hybrid") - F.col("bm25")), 6).alias("delta"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(b.text), '[^\\p{L}\\p{N}\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> ''))"
_SCORE = f"SELECT query_id, avg(len(list_filter({_TOK}, lambda x: contains(lower(d.text), x))) / len({_TOK})) AS r FROM {{0}} JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id) GROUP BY 1"
R.add("side_by_side", side_by_side,
      f"WITH {_LISTS}, {_bm25('bm', '(SELECT item_id AS query_id, text FROM benchmark)', 15)}, x AS ({_SCORE.replace('{0}', 'bm')}), y AS ({_SCORE.replace('{0}', '(SELECT * FROM fused WHERE rank <= 15)')}) SELECT round(avg(x.r), 6) AS bm25, round(avg(y.r), 6) AS hybrid, round(avg(y.r - x.r), 6) AS delta FROM x JOIN y USING (query_id)")


def measured(s: SparkSession, d: str) -> DataFrame:
    """Four measures of both engines on the items' first five documents; two of them stand in labelled answers, and are read back."""
    docs = load(s, d, "documents")
    engines = {"bm25": RT.bm25_topk(asked(s, d), docs, 5).select("query_id", "doc_id", "rank"), "hybrid": fused(s, d).where("rank <= 5").select("query_id", "doc_id", "rank")}
    out = {}
    for name, found in engines.items():
        pairs = RT.with_text(found.join(asked(s, d).withColumnRenamed("text", "q"), "query_id"), docs.select("doc_id", "text"))
        cross = pairs.select("query_id", F.round(RT.lexical_score(F.col("text"), F.col("q")), 9).alias("cross"), "rank", "text")
        precision = E.context_precision(asked(s, d), cross)
        recall = E.keyword_recall(asked(s, d).select("query_id", F.split(F.lower("text"), " ").alias("words")), cross)
        best = cross.groupBy("query_id").agg(F.max("cross").alias("m"))
        answer = F.format_string("FAITHFULNESS: %.2f\nRELEVANCE: %.2f", 1 + 4 * F.col("m"), 5 * F.col("m"))
        judged = best.select("query_id", E.parse_score(answer, "FAITHFULNESS", 3.0).alias("faithfulness"), E.parse_score(answer, "RELEVANCE", 3.0).alias("relevance"))
        out[name] = precision.join(recall, "query_id").join(judged, "query_id")
    return E.side_by_side(out, ("precision", "recall", "faithfulness", "relevance")).select("measure", *[F.round(c, 4).alias(c) for c in ("bm25", "hybrid", "delta")])


_SCORED = """SELECT query_id, d.text, round(1 / (1 + exp(-(8 * least(1.0, 0.7 * len(h) / n + 0.3 * CASE WHEN len(h) > 0 THEN 1 - list_min(list_transform(h, lambda x: instr(lower(d.text), x) - 1)) / greatest(1, length(d.text)) ELSE 0 END) - 4))), 9) AS "cross" FROM (SELECT r.query_id, r.doc_id, list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda x: x <> '') AS t, len(t) AS n, list_filter(t, lambda x: contains(lower(x_.text), x)) AS h FROM {0} r JOIN benchmark b ON b.item_id = r.query_id JOIN documents x_ USING (doc_id)) JOIN documents d USING (doc_id)"""
_MEASURES = """SELECT item_id, coalesce(p, 0.0) AS "precision", r AS recall, CASE WHEN round(1 + 4 * m, 2) BETWEEN 1 AND 5 THEN round(1 + 4 * m, 2) ELSE 3 END AS faithfulness, CASE WHEN round(5 * m, 2) BETWEEN 1 AND 5 THEN round(5 * m, 2) ELSE 3 END AS relevance FROM benchmark LEFT JOIN (SELECT query_id, avg(CASE WHEN "cross" > 0.5 THEN 1.0 ELSE 0.0 END) AS p, max("cross") AS m FROM {0} GROUP BY 1) ON query_id = item_id JOIN (SELECT query_id, avg(hit) AS r FROM (SELECT query_id, w, max(CASE WHEN contains(lower(text), w) THEN 1 ELSE 0 END) AS hit FROM (SELECT DISTINCT item_id AS query_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) JOIN {0} USING (query_id) GROUP BY ALL) GROUP BY 1) w ON w.query_id = item_id"""
R.add("side_by_side_measures", measured,
      f"WITH {_LISTS}, {_bm25('bm', '(SELECT item_id AS query_id, text FROM benchmark)', 5)}, sa AS ({_SCORED.format('bm')}), sb AS ({_SCORED.format('(SELECT * FROM fused WHERE rank <= 5)')}), x AS ({_MEASURES.format('sa')}), y AS ({_MEASURES.format('sb')}) "
      + " UNION ALL ".join(f"""SELECT '{m}' AS measure, round(avg(x."{m}"), 4) AS bm25, round(avg(y."{m}"), 4) AS hybrid, round(avg(y."{m}") - avg(x."{m}"), 4) AS delta FROM x JOIN y USING (item_id)""" for m in ("precision", "recall", "faithfulness", "relevance")))


def pair_scores(d: DataFrame) -> DataFrame:
    """Values in each shape that a pair scorer may answer with, and in two that it may not."""
    v, k = F.round("value", 3), F.col("event_id") % 6
    a, b = F.concat(v.cast("string")), F.lit("0.5")
    raw = F.when(k == 0, F.concat(F.lit("["), a, F.lit(","), b, F.lit(",9]"))).when(k == 1, F.concat(F.lit("[["), a, F.lit(",7],["), b, F.lit("]]")))
    raw = raw.when(k == 2, F.concat(F.lit('[[{"score":'), a, F.lit('}],[{"score":'), b, F.lit("}]]"))).when(k == 3, F.concat(F.lit('{"scores":['), a, F.lit(","), b, F.lit(",9]}"))).when(k == 4, F.lit('[{"score":1}]')).otherwise(F.lit("no json"))
    return d.select("event_id", E.parse_pair_scores(raw, F.lit(2)).alias("p")).select("event_id", F.size(F.coalesce("p", F.array().cast("array<double>"))).alias("n"), F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(1)).alias("second"))


R.on("parse_pair_scores", "events", pair_scores,
     "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN 2 ELSE 0 END AS n, CASE WHEN event_id % 6 < 4 THEN round(value, 3) END AS first, CASE WHEN event_id % 6 < 4 THEN 0.5 END AS second FROM events")


def batch_files(s: SparkSession, d: str) -> DataFrame:
    """Pages as batch manifests, a file each hundred in one of two forms, parsed whole."""
    folder = jobs.work_dir(s, "manifests")
    pages = load(s, d, "pages").select(F.floor(F.col("page_id") / 100).alias("part"), "page_id", "url")
    entry = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct("url", F.col("page_id").cast("string").alias("title")))).when(F.col("page_id") % 3 == 1, F.to_json(F.struct(F.col("url").alias("pdf"))))
    array = F.concat(F.lit("["), F.array_join(F.collect_list(F.coalesce(entry, F.concat(F.lit('"'), "url", F.lit('"')))), ","), F.lit("]"))
    text = F.array_join(F.concat(F.array(F.lit("# a list"), F.lit("")), F.collect_list(F.coalesce(entry, F.col("url")))), "\n")
    whole = pages.groupBy("part").agg(F.when(F.col("part") % 2 == 0, array).otherwise(text).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return files.parse_batch_manifest(s, folder).select("kind", "value", "title")


R.add("parse_batch_files", batch_files, "SELECT CASE WHEN page_id % 3 = 1 THEN 'pdf' ELSE 'url' END AS kind, url AS value, CASE WHEN page_id % 3 = 0 THEN page_id::VARCHAR END AS title FROM pages")


def _chunks(docs: DataFrame) -> DataFrame:
    return lines(docs).select("doc_id", "line_no", "text")


def _synced(s: SparkSession, d: str, later: bool) -> Snapshots:
    """Documents arrive as a stream in two micro-batches, and then, in a second run from the same checkpoint, their later state."""
    table = Snapshots(s, jobs.work_dir(s, "snapshots"), "doc_id long, line_no long, text string", 16)
    inbox, state = jobs.work_dir(s, "inbox"), jobs.work_dir(s, "sync")
    apply = lambda batch, n: table.apply(batch.drop("part"), n, _chunks)
    old, new = versions(s, d)
    half = old.select("doc_id", "title", "text", (F.col("doc_id") % 2).alias("part"))
    jobs.sync(jobs.arrive(half, F.col("part"), 2, inbox), apply, state)
    if later:
        jobs.sync(jobs.arrive(new.select("doc_id", "title", "text", F.lit(0).cast("long").alias("part")), F.col("part"), 1, inbox), apply, state)
    return table


R.add("stream_sync", lambda s, d: _synced(s, d, False).read("chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks")), f"SELECT doc_id, count(*) AS chunks FROM ({LINES_SQL}) GROUP BY 1")
R.add("snapshot_sync", lambda s, d: _synced(s, d, True).read("chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars")), SYNCED_SQL)
R.add("snapshot_documents", lambda s, d: _synced(s, d, True).read("documents"),
      f"WITH {NEW_SQL} SELECT doc_id, CASE WHEN change IN ('failed', 'skipped') OR change IS NULL THEN d.source ELSE w.title END AS title, sha256(CASE WHEN change IN ('created', 'updated') THEN w.text ELSE d.text END) AS hash FROM documents d FULL JOIN w USING (doc_id) LEFT JOIN c USING (doc_id)")
R.add("snapshot_log", lambda s, d: _synced(s, d, True).log().select("batch", F.explode(F.from_json("changes", "map<string,long>")).alias("change", "n")).distinct(),
      f"WITH {NEW_SQL} SELECT doc_id % 2 AS batch, 'created' AS change, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 2, change, count(*) FROM c GROUP BY ALL")


def published(s: SparkSession, d: str) -> DataFrame:
    """Tables published in the order of what they refer to, then reconciled from what was published."""
    tables = {n: load(s, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    target = Publisher(s, jobs.work_dir(s, "publish"))
    target.publish(tables, {"lineitem": ["orders"], "orders": ["customer"], "customer": ["nation"], "nation": ["region"]}, "1")
    order = s.createDataFrame([(t, i) for i, t in enumerate(target.order)], "table_name string, place long")
    return files.reconcile(tables, target.read()).join(order, "table_name")


R.add("publish_tables", published,
      "SELECT table_name, n AS source_rows, n AS target_rows, 'OK' AS state, place FROM (SELECT 'region' AS table_name, count(*) AS n, 0 AS place FROM region UNION ALL SELECT 'nation', count(*), 1 FROM nation UNION ALL SELECT 'customer', count(*), 2 FROM customer UNION ALL SELECT 'orders', count(*), 3 FROM orders UNION ALL SELECT 'lineitem', count(*), 4 FROM lineitem)")
