"""Joins, aggregates, windows, pages and set operations on events, orders, customers and conversations.

A `view` event stands for a user's message and the next `purchase` of the same user for its answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import analytics as A

from .base import AS_OF, Registry, load

R = Registry()


def ask() -> Column:
    return F.col("event_type") == "view"


def answer() -> Column:
    return F.col("event_type") == "purchase"


def mode() -> Column:
    return F.get_json_object("props", "$.k")


_NEXT = "(SELECT min(struct_pack(ts := a.ts, id := a.event_id, value := a.value)) FROM events a WHERE a.event_type = 'purchase' AND a.user_id = m.user_id AND a.ts {op} m.ts)"


def paired(events: DataFrame, strict: bool = True) -> DataFrame:
    return A.next_answer(events, "user_id", "ts", "event_id", answer(), {"value": F.col("value")}, strict).where(ask())


_cols = ["event_id", "user_id", "answer.id AS answer_id", "answer.value AS latency"]
R.on("recent_queries", "events", lambda d: paired(d).where("answer is not null").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).selectExpr(*_cols),
     f"SELECT event_id, user_id, p.id AS answer_id, p.value AS latency FROM (SELECT *, {_NEXT.format(op='>')} AS p FROM events m WHERE event_type = 'view') WHERE p IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 50")
R.on("answered_queries", "events", lambda d: paired(d).where("answer is not null").selectExpr(*_cols),
     f"SELECT event_id, user_id, p.id AS answer_id, p.value AS latency FROM (SELECT *, {_NEXT.format(op='>')} AS p FROM events m WHERE event_type = 'view') WHERE p IS NOT NULL")
R.on("query_detail", "events", lambda d: paired(d, strict=False).selectExpr(*_cols),
     f"SELECT event_id, user_id, p.id AS answer_id, p.value AS latency FROM (SELECT *, {_NEXT.format(op='>=')} AS p FROM events m WHERE event_type = 'view')")
R.on("failed_queries", "events", lambda d: A.unanswered(d, "user_id", "ts", ask(), answer()).select("event_id", "user_id"),
     "SELECT event_id, user_id FROM events m WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'purchase' AND a.user_id = m.user_id AND a.ts > m.ts)")


def regenerate(conv: DataFrame) -> DataFrame:
    both = A.previous(conv, "conv_id", ["turn"], F.col("role") == "user", F.col("turn"), "user_turn")
    return both.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("answer_turn"), F.max_by("user_turn", "turn").alias("user_turn"))


R.on("regenerate_pairs", "conversations", regenerate,
     "SELECT conv_id, answer_turn, (SELECT max(turn) FROM conversations u WHERE u.conv_id = a.conv_id AND u.role = 'user' AND u.turn < answer_turn) AS user_turn FROM (SELECT conv_id, max(turn) AS answer_turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id) a")
R.add("guest_usage", lambda s, d: load(s, d, "orders").where("o_orderstatus <> 'F'").join(load(s, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).withColumn("capped", F.col("n") >= 5),
      "SELECT o_custkey, count(*) AS n, count(*) >= 5 AS capped FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey")
R.add("empty_conversations", lambda s, d: load(s, d, "customer").join(load(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("guests")),
      "SELECT count(*) AS total, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS guests FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")


def users_with_counts(s: SparkSession, d: str) -> DataFrame:
    users = load(s, d, "customer").where("c_mktsegment <> 'BUILDING'").orderBy(F.desc("c_custkey")).limit(500)
    counts = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return users.join(counts, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"))


R.add("users_with_counts", users_with_counts, "SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING' ORDER BY c_custkey DESC LIMIT 500)")
R.on("conversation_list", "conversations", lambda d: d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"), F.substring(F.max_by("text", "turn"), 1, 90).alias("preview")).orderBy(F.desc("last_turn"), F.desc("conv_id")).limit(21),
     "SELECT conv_id, count(*) AS n, max(turn) AS last_turn, substr(arg_max(text, turn), 1, 90) AS preview FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id DESC LIMIT 21")
R.add("owned_only", lambda s, d: load(s, d, "orders").join(load(s, d, "customer").where("c_nationkey = 7"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey"),
      "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
R.add("lookup_join", lambda s, d: load(s, d, "customer").join(load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")),
      "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_RECENT = f"ts >= {AS_OF}::TIMESTAMP - INTERVAL {{n}} DAY".replace("timestamp ", "")
R.on("message_stats", "events", lambda d: A.message_stats(d.where(A.within(F.col("ts"), AS_OF, 14)), answer(), F.col("value") < 10, F.when(answer(), F.col("value"))).select("answers", "cached", F.round("avg_latency", 6).alias("avg_latency")),
     f"SELECT count(*) FILTER (WHERE event_type = 'purchase') AS answers, count(*) FILTER (WHERE event_type = 'purchase' AND value < 10) AS cached, round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS avg_latency FROM events WHERE {_RECENT.format(n=14)}")


def admin_metrics(s: SparkSession, d: str) -> DataFrame:
    users = load(s, d, "customer").agg(F.count_if(F.col("c_mktsegment") != "BUILDING").alias("users"))
    convs = load(s, d, "conversations").agg(F.count_distinct("conv_id").alias("conversations"), F.count(F.lit(1)).alias("messages"))
    stats = A.message_stats(load(s, d, "events"), answer(), F.col("value") < 10, F.col("value"))
    docs = load(s, d, "documents").agg(F.count(F.lit(1)).alias("documents"))
    one = users.crossJoin(convs).crossJoin(stats).crossJoin(docs)  # a row each
    return one.select("users", "conversations", "messages", "documents", F.round(F.coalesce(F.try_divide("cached", "answers"), F.lit(0.0)), 6).alias("hit_rate"), F.round(F.coalesce("avg_latency", F.lit(0.0)), 6).alias("avg_latency"))


R.add("admin_metrics", admin_metrics, "SELECT (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING') AS users, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT count(*) FROM conversations) AS messages, (SELECT count(*) FROM documents) AS documents, round(count(*) FILTER (WHERE event_type = 'purchase' AND value < 10) / count(*) FILTER (WHERE event_type = 'purchase'), 6) AS hit_rate, round(avg(value), 6) AS avg_latency FROM events")
_DAILY = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1"
daily = lambda d: A.daily_counts(d, "ts", ask())
R.on("daily_queries", "events", lambda d: A.daily_counts(d, "ts", ask() & A.within(F.col("ts"), AS_OF, 14)), f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'view' AND {_RECENT.format(n=14)} GROUP BY 1")
R.on("mode_split", "events", lambda d: A.share_by(d, mode(), "mode").select("mode", "n", F.round("share", 6).alias("share")), "SELECT json_extract_string(props, '$.k') AS mode, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
R.on("top_questions", "events", lambda d: d.where(ask()).groupBy("props").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).orderBy(F.desc("n"), F.desc("last"), "props").limit(10).select("props", "n"),
     "SELECT props, n FROM (SELECT props, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY props ORDER BY n DESC, last DESC, props LIMIT 10)")
R.on("source_stats", "orders", lambda d: d.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("pending")),
     "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS pending FROM orders")
R.on("corpus_stats", "documents", lambda d: d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("text").rlike("[äöüßÄÖÜ]")) * 1000 / F.count(F.lit(1))).alias("per_mille")).orderBy(F.desc("n"), "source").limit(6),
     "SELECT source, count(*) AS n, round(count(*) FILTER (WHERE regexp_matches(text, '[äöüßÄÖÜ]')) * 1000 / count(*)) AS per_mille FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 6")
R.on("conversation_stats", "orders", lambda d: d.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "F").alias("live"), F.count_if((F.col("o_orderstatus") != "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("pinned"), F.count_if(F.col("o_orderstatus") == "F").alias("deleted")),
     "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'F') AS live, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT') AS pinned, count(*) FILTER (WHERE o_orderstatus = 'F') AS deleted FROM orders GROUP BY o_custkey")


def calls(d: DataFrame) -> DataFrame:
    """Events as a log of model calls: stage from the type, tokens and latency from the value, model from the user."""
    stage = F.when(ask(), "Research agent").when(answer(), "Writer").when(F.col("event_type") == "click", "Analyst").otherwise("Other")
    model = F.element_at(F.array(*[F.lit(m) for m, _, _ in A.PRICES], F.lit("unknown")), (F.col("user_id") % 4 + 1).cast("int"))
    tokens = F.floor(F.col("value") * 100)
    return d.select("event_id", stage.alias("stage"), F.when(F.col("user_id") % 5 == 0, "hf").otherwise("groq").alias("provider"), model.alias("model"), tokens.alias("prompt_tokens"), F.floor(tokens / 2).alias("completion_tokens"), F.col("value").alias("latency_ms"))


_CALLS = """SELECT event_id, stage, prompt_tokens, prompt_tokens // 2 AS completion_tokens, latency_ms, CASE WHEN p = 'hf' THEN 0.0 ELSE prompt_tokens / 1e6 * (CASE WHEN m IN (1, 2) THEN 0.59 ELSE 0.05 END) + (prompt_tokens // 2) / 1e6 * (CASE WHEN m IN (1, 2) THEN 0.79 ELSE 0.08 END) END AS cost_usd FROM (
SELECT event_id, CASE event_type WHEN 'view' THEN 'Research agent' WHEN 'purchase' THEN 'Writer' WHEN 'click' THEN 'Analyst' ELSE 'Other' END AS stage, CASE WHEN user_id % 5 = 0 THEN 'hf' ELSE 'groq' END AS p, user_id % 4 AS m, floor(value * 100)::BIGINT AS prompt_tokens, value AS latency_ms FROM events)"""
R.on("llm_cost", "events", lambda d: A.llm_cost(calls(d)).select("event_id", F.round("cost_usd", 9).alias("cost_usd")), f"SELECT event_id, round(cost_usd, 9) AS cost_usd FROM ({_CALLS})")
R.on("agent_costs", "events", lambda d: A.agent_costs(A.llm_cost(calls(d))).select("agent", "calls", "prompt_tokens", "completion_tokens", F.round("latency_ms", 4).alias("latency_ms"), F.round("cost_usd", 6).alias("cost_usd")),
     f"SELECT CASE WHEN stage LIKE 'Res%' THEN 'research' WHEN stage LIKE 'Ana%' THEN 'analyst' ELSE 'writer' END AS agent, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(sum(latency_ms), 4) AS latency_ms, round(sum(cost_usd), 6) AS cost_usd FROM ({_CALLS}) WHERE stage <> 'Other' GROUP BY 1")
R.on("pipeline_totals", "events", lambda d: A.llm_cost(calls(d)).agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.round(F.sum("latency_ms"), 4).alias("latency_ms"), F.when(F.bool_or(F.col("provider") == "hf"), "hf").otherwise("groq").alias("engine")),
     f"SELECT round(sum(cost_usd), 6) AS cost_usd, round(sum(latency_ms), 4) AS latency_ms, (SELECT CASE WHEN bool_or(user_id % 5 = 0) THEN 'hf' ELSE 'groq' END FROM events) AS engine FROM ({_CALLS})")
_H24 = f"ts >= {AS_OF.replace('timestamp ', '')}::TIMESTAMP - INTERVAL 24 HOUR"
R.on("job_stats", "events", lambda d: d.agg(F.count_if(ask()).alias("queued"), F.count_if(F.col("event_type") == "click").alias("running"), F.count_if(answer() & A.within(F.col("ts"), AS_OF, 1)).alias("done"), F.count_if((F.col("event_type") == "error") & A.within(F.col("ts"), AS_OF, 1)).alias("failed")),
     f"SELECT count(*) FILTER (WHERE event_type = 'view') AS queued, count(*) FILTER (WHERE event_type = 'click') AS running, count(*) FILTER (WHERE event_type = 'purchase' AND {_H24}) AS done, count(*) FILTER (WHERE event_type = 'error' AND {_H24}) AS failed FROM events")
R.on("ingest_summary", "orders", lambda d: d.rollup("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("o_orderstatus", F.lit("total")).alias("status"), "n"),
     "SELECT coalesce(o_orderstatus, 'total') AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
R.on("chunk_totals", "documents", lambda d: d.agg(F.sum(F.ceil(F.col("n_chars") / 600)).alias("chunks"), F.max("doc_id").alias("last")), "SELECT sum(ceil(n_chars / 600))::BIGINT AS chunks, max(doc_id) AS last FROM documents")
R.on("latency_percentiles", "events", lambda d: A.percentiles(d, ["event_type"], "value").select("event_type", F.round("median", 6).alias("median"), "p95"),
     "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")


def sketched(d: DataFrame) -> DataFrame:
    """Percentiles of each type from sketches by day, merged; and whether their true ranks lie within 1 % of those asked for."""
    ranks = {"median": 0.5, "p95": 0.95}
    told = A.sketched_percentiles(A.quantile_sketches(d.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value"), ["event_type"], ranks)
    off = A.rank_errors(d, ["event_type"], "value", told, ranks)
    return told.join(off.select("event_type", *[(F.col(c) <= 0.01).alias(f"{c}_within") for c in ranks]), "event_type").select("event_type", "n", "median_within", "p95_within")


R.on("sketched_percentiles", "events", sketched, "SELECT event_type, count(value) AS n, true AS median_within, true AS p95_within FROM events GROUP BY event_type")
R.on("day_label", "events", lambda d: d.select("event_id", A.day_label(F.date_format("ts", "yyyy-MM-dd"), F.expr(AS_OF)).alias("label")),
     f"SELECT event_id, CASE WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Yesterday' WHEN n < 7 THEN strftime(ts, '%a') ELSE strftime(ts, '%b ') || day(ts) END AS label FROM (SELECT *, date_diff('day', ts::DATE, {AS_OF.replace('timestamp ', '')}::DATE) AS n FROM events)")
R.on("export_markdown", "conversations", lambda d: A.joined_text(d, ["conv_id"], "turn", F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.col("text")), "\n\n", "markdown"),
     "SELECT conv_id, string_agg('## ' || upper(substr(role, 1, 1)) || substr(role, 2) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
R.on("stage_timings", "events", lambda d: d.select(F.explode(F.from_json(F.to_json(F.array(F.struct(F.lit("retrieve").alias("stage"), F.col("value").alias("ms"), ask().alias("ran")), F.struct(F.lit("write").alias("stage"), F.when(answer(), F.col("value")).otherwise(0.0).alias("ms"), answer().alias("ran")))), "array<struct<stage:string,ms:double,ran:boolean>>")).alias("x")).select("x.*").groupBy("stage").agg(F.count_if("ran").alias("executed"), F.round(F.avg("ms"), 6).alias("avg_ms")),
     "SELECT 'retrieve' AS stage, count(*) FILTER (WHERE event_type = 'view') AS executed, round(avg(value), 6) AS avg_ms FROM events UNION ALL SELECT 'write', count(*) FILTER (WHERE event_type = 'purchase'), round(avg(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 6) FROM events")
R.on("day_bucket", "events", lambda d: d.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), A.time_group(F.col("ts"), F.expr(AS_OF)).alias("bucket")),
     f"SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n <= 7 THEN 'previous7' ELSE 'older' END AS bucket FROM (SELECT *, date_diff('day', ts::DATE, {AS_OF.replace('timestamp ', '')}::DATE) AS n FROM events)")
R.on("preview_title", "conversations", lambda d: d.groupBy("conv_id").agg(F.substring(F.max_by("text", "turn"), 1, 90).alias("preview"), F.substring(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))), 1, 48).alias("title")),
     "SELECT conv_id, substr(arg_max(text, turn), 1, 90) AS preview, substr(arg_min(text, turn) FILTER (WHERE role = 'user'), 1, 48) AS title FROM conversations GROUP BY conv_id")
R.on("composed_predicates", "events", lambda d: d.where(F.col("event_type").isin("view", "purchase") & (mode().try_cast("int") >= 50) & F.col("ts").between(F.expr("timestamp_ntz '2024-01-05 00:00:00'"), F.expr("timestamp_ntz '2024-01-20 00:00:00'"))).select("event_id", "user_id"),
     "SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'purchase') AND try_cast(json_extract_string(props, '$.k') AS INT) >= 50 AND ts BETWEEN '2024-01-05' AND '2024-01-20'")
R.on("time_window", "events", lambda d: d.where(A.within(F.col("ts"), AS_OF, 7)).select("event_id"), f"SELECT event_id FROM events WHERE {_RECENT.format(n=7)}")
R.on("format_relative", "events", lambda d: d.select("event_id", A.age_label(F.unix_timestamp(F.expr(AS_OF)) - F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("age")),
     f"SELECT event_id, CASE WHEN s < 10 THEN 'now' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM (SELECT event_id, (epoch({AS_OF.replace('timestamp ', '')}::TIMESTAMP) - floor(epoch(ts)))::BIGINT AS s FROM events)")
R.on("day_over_day", "events", lambda d: A.day_over_day(daily(d)).select("day", "n", "change", F.round("average", 6).alias("average")),
     f"SELECT day, n, CASE WHEN p > 0 THEN floor((n - p) * 100 / p + 0.5)::BIGINT END AS change, round(avg(n) OVER (), 6) AS average FROM (SELECT *, lag(n) OVER (ORDER BY day) AS p FROM ({_DAILY}))")
R.on("half_period_trend", "events", lambda d: A.half_period_trend(daily(d)),
     f"SELECT early, late, CASE WHEN days >= 4 AND early > 0 THEN floor((late - early) * 100 / early + 0.5)::BIGINT END AS trend FROM (SELECT max(c) AS days, sum(n) FILTER (WHERE i <= c // 2)::BIGINT AS early, sum(n) FILTER (WHERE i > c // 2)::BIGINT AS late FROM (SELECT n, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS c FROM ({_DAILY})))")
R.on("cache_health_band", "events", lambda d: d.where(answer()).groupBy("user_id").agg(F.avg(F.when(F.col("value") < 50, 1.0).otherwise(0.0)).alias("rate")).select("user_id", A.half_up(F.col("rate") * 100).alias("percent"), A.health_band(F.col("rate")).alias("band")),
     "SELECT user_id, floor(r * 100 + 0.5)::BIGINT AS percent, CASE WHEN r >= 0.6 THEN 'healthy' WHEN r >= 0.3 THEN 'fair' ELSE 'low' END AS band FROM (SELECT user_id, avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END) AS r FROM events WHERE event_type = 'purchase' GROUP BY user_id)")
_CHAT = "role IN ('user', 'assistant')"
R.on("last_n_memory", "conversations", lambda d: A.joined_text(A.last_n(d.where(_CHAT), "conv_id", "turn").where("not evicted"), ["conv_id"], "turn", F.concat_ws(": ", F.initcap("role"), "text"), "\n", "context"),
     "SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations WHERE role IN ('user', 'assistant')) WHERE i <= 8 GROUP BY conv_id")
R.on("evicted_turn_prompts", "conversations", lambda d: A.previous(A.last_n(d.where(_CHAT), "conv_id", "turn", 4), "conv_id", ["turn"], F.col("role") == "user", F.col("text"), "user_text").where("evicted and role = 'assistant'").select("conv_id", "turn", "user_text", F.substring("text", 1, 200).alias("answer")),
     "SELECT conv_id, turn, user_text, substr(text, 1, 200) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_text FROM conversations WHERE role IN ('user', 'assistant')) WHERE i > 4 AND role = 'assistant'")
R.on("keep_latest_n", "orders", lambda d: A.keep_latest(d, [("o_orderdate", True), ("o_orderkey", True)], 5, F.col("o_orderstatus") == "P").groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")),
     "SELECT kept, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, o_orderstatus = 'P' OR row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5 AS kept FROM orders) GROUP BY kept")
R.on("dedupe_consecutive", "conversations", lambda d: A.drop_repeats(d, "conv_id", "turn", "role", "text").select("conv_id", "turn"),
     "SELECT conv_id, turn FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE NOT (r IS NOT DISTINCT FROM role AND t IS NOT DISTINCT FROM text)")
R.on("keyset_page", "orders", lambda d: A.keyset_page(d, [("o_orderdate", True), ("o_orderkey", True)], 21, (F.to_date(F.lit("1998-01-01")), F.lit(500))).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")),
     "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate < DATE '1998-01-01' OR (o_orderdate = DATE '1998-01-01' AND o_orderkey < 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
R.on("chunk_page", "documents", lambda d: A.keyset_page(d, [("doc_id", False)], 21, (F.lit(100),)).select("doc_id", "n_chars"), "SELECT doc_id, n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 21")
R.on("topk_per_group", "orders", lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("rank <= 3").select("o_orderpriority", "rank", "o_orderkey"),
     "SELECT o_orderpriority, rank, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
R.on("multi_key_sort", "part", lambda d: d.orderBy("p_type", F.desc("p_size"), "p_name", "p_partkey").limit(100).select("p_partkey", "p_type", "p_size"), "SELECT p_partkey, p_type, p_size FROM part ORDER BY p_type, p_size DESC, p_name, p_partkey LIMIT 100")
R.on("sample_n", "documents", lambda d: d.orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id").limit(50).select("doc_id"), "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
R.on("split_holdout", "benchmark", lambda d: d.join(F.broadcast(d.orderBy(F.desc("item_id")).limit(20).select("item_id", F.lit(True).alias("held"))), "item_id", "left").select("item_id", F.coalesce("held", F.lit(False)).alias("held_out")),
     "SELECT item_id, row_number() OVER (ORDER BY item_id DESC) <= 20 AS held_out FROM benchmark")
R.on("distinct_ids", "events", lambda d: d.select("user_id", "event_type").distinct(), "SELECT DISTINCT user_id, event_type FROM events")
R.on("intersect_ids", "events", lambda d: d.where(ask()).select("user_id", mode().alias("k")).intersect(d.where(answer()).select("user_id", mode().alias("k"))), "SELECT user_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'view' INTERSECT SELECT user_id, json_extract_string(props, '$.k') FROM events WHERE event_type = 'purchase'")
R.on("except_ids", "events", lambda d: d.where(ask()).select("user_id", mode().alias("k")).exceptAll(d.where(answer()).select("user_id", mode().alias("k"))), "SELECT user_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'view' EXCEPT ALL SELECT user_id, json_extract_string(props, '$.k') FROM events WHERE event_type = 'purchase'")
R.on("union_all_lists", "events", lambda d: d.where(ask()).select("event_id", F.lit(1).alias("list_id")).unionByName(d.where(F.col("value") > 50).select("event_id", F.lit(2).alias("list_id"))), "SELECT event_id, 1 AS list_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 2 FROM events WHERE value > 50")
R.on("thread_dump", "conversations", lambda d: d.where("conv_id = 5").orderBy("turn").select("turn", "role", "text"), "SELECT turn, role, text FROM conversations WHERE conv_id = 5")
R.on("request_rate", "events", lambda d: d.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "15 minutes", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start"), "n"),
     "SELECT user_id, (b + 300 * o)::BIGINT AS start, count(*) AS n FROM (SELECT user_id, floor(epoch(ts) / 300)::BIGINT * 300 AS b FROM events), (SELECT unnest([-2, -1, 0]) AS o) GROUP BY 1, 2")
