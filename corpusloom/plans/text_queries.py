"""Projections, predicates and scalar functions on documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking

from .base import LINES_SQL, Registry, lines, load

R = Registry()
_STOP = ",".join(f"'{w}'" for w in dict.fromkeys(T.STOPWORDS))
_TOK = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> '')"
_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"



def cleaned(docs: DataFrame) -> DataFrame:
    """NFC comes first, as its own step: Python can't run inside a lambda."""
    return docs.select("doc_id", chunking.normalise("text").alias("text")).select("doc_id", T.clean_text(F.col("text")).alias("text"))


R.on(
    "clean_text", "documents",
    lambda d: cleaned(d),
    f"""WITH l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(translate(text, '' || chr(61548), '-'), chr(10)) AS l FROM documents)),
    n AS (SELECT *, {_STRIP.format('line')} AS t, count(*) OVER (PARTITION BY doc_id, {_STRIP.format('line')}) AS c FROM l),
    b AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (length(t) > 5 AND c > 3)), '') AS text FROM n GROUP BY doc_id),
    s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' \\n', chr(10), 'g'), chr(10)) AS l FROM b)
    SELECT doc_id, {_STRIP.format("array_to_string(list_filter(l, lambda x: length(" + _STRIP.format('x') + ") NOT BETWEEN 1 AND 2), chr(10))")} AS text FROM s""",
)
R.on(
    "drop_boilerplate_lines", "documents",
    lambda d: d.select("doc_id", T.without_boilerplate(F.col("text")).alias("text")),
    f"""WITH l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    n AS (SELECT *, {_STRIP.format('line')} AS t, count(*) OVER (PARTITION BY doc_id, {_STRIP.format('line')}) AS c FROM l)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (length(t) > 5 AND c > 3)), '') AS text FROM n GROUP BY doc_id""",
)
R.on(
    "token_estimate", "documents",
    lambda d: d.select("doc_id", T.tokens_floor(F.col("text")).alias("n_floor"), T.tokens_ceil(F.col("text")).alias("n_ceil")),
    "SELECT doc_id, length(text) // 4 AS n_floor, greatest(1, (length(text) + 3) // 4) AS n_ceil FROM documents",
)
R.on(
    "text_stats", "documents",
    lambda d: d.select("doc_id", F.length("text").cast("long").alias("chars"), F.size(T.words(F.col("text"))).cast("long").alias("words"), T.tokens_floor(F.col("text")).alias("tokens"), F.size(F.split("text", "\n")).cast("long").alias("lines")),
    f"SELECT doc_id, length(text) AS chars, len({_WORDS.format('text')}) AS words, length(text) // 4 AS tokens, len(string_split(text, chr(10))) AS lines FROM documents",
)
R.on(
    "html_main_text", "pages",
    lambda d: d.select("page_id", T.html_title(F.col("html")).alias("title"), F.length(T.html_region(F.col("html"))).cast("long").alias("region_chars"), T.html_text(F.col("html")).alias("text")),
)
R.on(
    "html_region", "pages",
    lambda d: d.select("page_id", F.length(T.html_region(F.col("html"))).cast("long").alias("region_chars"), F.length(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).cast("long").alias("raw_title_chars")),
    r"""SELECT page_id, length(coalesce(nullif(regexp_extract(html, '(?is)<main[\s>].*?</main>'), ''), nullif(regexp_extract(html, '(?is)<article[\s>].*?</article>'), ''),
    nullif(regexp_extract(html, '(?is)<body[^>]*>.*?</body>'), ''), html)) AS region_chars, length(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS raw_title_chars FROM pages""",
)
R.on(
    "length_gate", "documents",
    lambda d: d.select("doc_id", (F.length(T.strip(F.col("text"))) >= 200).alias("is_page"), (F.length(T.strip(F.col("text"))) >= 100).alias("is_chunk")),
    f"SELECT doc_id, length({_STRIP.format('text')}) >= 200 AS is_page, length({_STRIP.format('text')}) >= 100 AS is_chunk FROM documents",
)
R.on(
    "tokenize_bm25", "documents",
    lambda d: d.select("doc_id", F.size(T.tokenize(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(T.tokenize(F.col("text")), " ")).alias("tokens_md5")),
    f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)",
)
R.on(
    "tokenize_fts", "benchmark",
    lambda d: d.select("item_id", F.array_join(T.tokenize_fts(F.col("text")), " ").alias("tokens")),
    f"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '[\\s-]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP})), ' ') AS tokens FROM benchmark",
)


def _pii_sql(source: str, classes=T.PII) -> str:
    """The oracle's patterns: edges as captured context where RE2 knows no lookbehind; applied twice, as context is consumed."""
    c = source
    for name, pattern, mark in classes:
        body = pattern.replace(T._B, r"(^|[^0-9A-Za-z_])").replace(T._E, "").replace(r"(?<![A-Z0-9])", "(^|[^A-Z0-9])")
        body = body.replace("'", "''")
        if name == "dob":
            first, second = pattern.split("|" + T._B)
            body = "(^|[^0-9A-Za-z_])(?:" + first.replace(T._B, "").replace(T._E, "") + "|" + second.replace(T._E, "") + ")"
        for _ in range(2):
            c = f"regexp_replace({c}, '{body}\\b', '\\1{mark}', 'g')"
    return c


for _name, _table, _id in (("mask_pii", "documents", "doc_id"), ("mask_pii_messages", "conversations", "conv_id, turn")):
    R.on(
        _name, _table,
        lambda d, ids=_id.split(", "): d.select(*ids, T.mask_pii(F.col("text")).alias("text"), (T.mask_pii(F.col("text")) != F.col("text")).alias("found")),
        f"SELECT {_id}, m AS text, m <> text AS found FROM (SELECT {_id}, text, {_pii_sql('text')} AS m FROM {_table})",
    )


def _pii_counts_sql() -> str:
    """Marks that a class adds to the text in which the classes before are masked."""
    steps = ["text AS c0"]
    counts = []
    for i, (name, _, mark) in enumerate(T.PII):
        steps.append(f"{_pii_sql(f'c{i}', [T.PII[i]])} AS c{i + 1}")
        marks = lambda k, mark=mark: f"(length(c{k}) - length(replace(c{k}, '{mark}', ''))) // {len(mark)}"
        counts.append(f"{marks(i + 1)} - {marks(i)} AS {name}")
    return f"SELECT doc_id, {', '.join(counts)} FROM (SELECT doc_id, {', '.join(steps)} FROM documents)"


R.on("pii_counts", "documents", lambda d: d.select("doc_id", *[c.alias(n) for n, c in T.pii_counts(F.col("text")).items()]), _pii_counts_sql())
R.on(
    "content_hash", "documents",
    lambda d: d.select("doc_id", F.sha2("text", 256).alias("hash"), T.source_key(F.concat_ws(" ", "source", "lang"), F.sha2("text", 256)).alias("source_key")),
    "SELECT doc_id, sha256(text) AS hash, 'doc://' || substr(sha256(text), 1, 16) || '/' || regexp_replace(lower(source || ' ' || lang), '[^0-9A-Za-z_.\\-]+', '_', 'g') AS source_key FROM documents",
)
R.on(
    "query_hash", "conversations",
    lambda d: d.where("role = 'user'").select("conv_id", "turn", T.query_hash(F.col("text")).alias("hash")),
    f"SELECT conv_id, turn, sha256(lower({_STRIP.format('text')})) AS hash FROM conversations WHERE role = 'user'",
)
_TERMS = ("the", "worthless", "password")
R.on(
    "negative_term_flag", "conversations",
    lambda d: d.select("conv_id", "turn", T.contains_any(F.col("text"), (*T.NEGATIVE_TERMS, *_TERMS)).alias("negative")),
    "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{t}')" for t in (*T.NEGATIVE_TERMS, *_TERMS)) + " AS negative FROM conversations",
)
_PRON = ",".join(f"'{w}'" for w in T.PRONOUNS)
R.on(
    "vague_query_flag", "conversations",
    lambda d: d.where("role = 'user'").select("conv_id", "turn", T.vague(F.col("text")).alias("vague")),
    f"""SELECT conv_id, turn, len(w) <= 3 OR (len(list_filter(w, lambda x: x IN ({_PRON}))) >= 2 AND len(list_filter(w, lambda x: regexp_matches(x, '\\b({"|".join(T.DOMAIN_WORDS)})\\b'))) = 0) AS vague
    FROM (SELECT conv_id, turn, {_WORDS.format('lower(text)')} AS w FROM conversations WHERE role = 'user')""",
)
R.on(
    "route_flags", "conversations",
    lambda d: d.where("role = 'user'").select("conv_id", "turn", T.contains_any(F.col("text"), T.COMPARE_TERMS).alias("compares"), T.contains_any(F.col("text"), T.COST_TERMS).alias("costs"), F.concat("text", F.lit(" requirements breakdown")).alias("sub_query")),
    "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{t}')" for t in T.COMPARE_TERMS) + " AS compares, " + " OR ".join(f"contains(lower(text), '{t}')" for t in T.COST_TERMS) + " AS costs, text || ' requirements breakdown' AS sub_query FROM conversations WHERE role = 'user'",
)
R.on(
    "url_flags", "pages",
    lambda d: d.select("page_id", *[c.alias(n) for n, c in T.url_flags(F.col("url")).items()]),
    r"""SELECT page_id, regexp_matches(url, '^(?i:https?)://') AS is_http, coalesce(regexp_matches(h, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') AND (a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)), false) AS is_private,
    CASE WHEN regexp_matches(lower(url), '^pdf://|\.pdf$') THEN 'pdf' ELSE 'web' END AS kind FROM (SELECT *, try_cast(split_part(h, '.', 1) AS INT) AS a, try_cast(split_part(h, '.', 2) AS INT) AS b FROM (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1) AS h FROM pages))""",
)
R.on(
    "query_text", "benchmark",
    lambda d: d.select("item_id", F.concat(F.lit(T.QUERY_PREFIX), T.strip(F.col("text"))).alias("query")),
    f"SELECT item_id, '{T.QUERY_PREFIX}' || {_STRIP.format('text')} AS query FROM benchmark",
)
R.on(
    "metadata_fields", "events",
    lambda d: d.select("event_id", F.get_json_object("props", "$.k").alias("mode"), F.get_json_object("props", "$.k").try_cast("double").alias("latency"), F.coalesce(F.get_json_object("props", "$.cached"), F.lit("false")).alias("is_cached")),
    "SELECT event_id, json_extract_string(props, '$.k') AS mode, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS latency, coalesce(json_extract_string(props, '$.cached'), 'false') AS is_cached FROM events",
)
R.on("umlaut_flag", "documents", lambda d: d.select("doc_id", T.umlauts(F.col("text")).alias("umlauts")), "SELECT doc_id, regexp_matches(text, '[äöüßÄÖÜ]') AS umlauts FROM documents")
_Q = "the password of all"
R.on(
    "term_coverage_score", "documents",
    lambda d: d.select("doc_id", F.round(T.coverage_score(F.col("text"), F.lit(_Q)), 6).alias("score")),
    f"""SELECT doc_id, round(least(1.0, 0.7 * len(h) / 4 + 0.3 * CASE WHEN len(h) > 0 THEN 1 - list_min(list_transform(h, lambda x: instr(lower(text), x) - 1)) / greatest(1, length(text)) ELSE 0 END), 6) AS score
    FROM (SELECT doc_id, text, list_filter(['the', 'password', 'of', 'all'], lambda x: contains(lower(text), x)) AS h FROM documents)""",
)
R.on(
    "normalize_subqueries", "benchmark",
    lambda d: d.select("item_id", F.array_join(chunking.normalize_subqueries(F.col("text"), F.split("text", r"[.!?]\s+"), 3), "\n").alias("queries")),
    f"""SELECT item_id, array_to_string(list_slice(q, 1, 3), chr(10)) AS queries FROM (SELECT item_id, list(substr(x, 1, 500) ORDER BY i) AS q FROM (
    SELECT item_id, x, min(i) AS i FROM (SELECT item_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT item_id, list_prepend(text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]\\s+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')) AS l FROM benchmark)) GROUP BY item_id, x) GROUP BY item_id)""",
)
R.on(
    "text_contains_filter", "documents",
    lambda d: d.where(F.contains(F.lower("text"), F.lit("token"))).orderBy("doc_id").limit(50).select("doc_id", "source"),
    "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'token') ORDER BY doc_id LIMIT 50",
)
R.on(
    "sigmoid", "embeddings",
    lambda d: d.select("vec_id", F.round(1 / (1 + F.exp(-F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")))), 6).alias("p")),
    "SELECT vec_id, round(1 / (1 + exp(-list_sum(embedding::DOUBLE[]))), 6) AS p FROM embeddings",
)
R.on(
    "scan_html_pages", "pages",
    lambda d: d.where((F.octet_length("html") <= 5 * 1024 * 1024) & (F.length("html") >= 200)).select("page_id", "url", F.octet_length("html").cast("long").alias("bytes")),
    "SELECT page_id, url, strlen(html) AS bytes FROM pages WHERE strlen(html) <= 5 * 1024 * 1024 AND length(html) >= 200",
)
R.add(
    "validate_chunks",
    lambda spark, d: chunking.validate(lines(load(spark, d, "documents")).withColumnRenamed("line_no", "chunk_no")),
    f"SELECT doc_id, line_no AS chunk_no, CASE WHEN length({_STRIP.format('text')}) < 100 THEN 'short' WHEN length(text) < 50 THEN 'below 50' ELSE 'ok' END AS reason FROM ({LINES_SQL})",
)
R.on("chunk_recursive", "documents", lambda d: chunking.chunk(d, "doc_id", "text"))


def lateral(spark: SparkSession, d: str) -> DataFrame:
    """chunk_recursive in SQL, by the table function."""
    chunking.register_chunk_text(spark)
    load(spark, d, "documents").createOrReplaceTempView("documents_to_chunk")
    size, overlap, least = chunking.FLAT
    return spark.sql(f"SELECT doc_id, c.chunk_no, c.text, CAST(length(c.text) AS BIGINT) AS char_count FROM documents_to_chunk, LATERAL chunk_text(text, {size}, {overlap}, {least}) c")


R.add("chunk_lateral", lateral)
R.on("chunk_parent_child", "documents", lambda d: chunking.parent_child(d, "doc_id", "text"))
R.on("chunk_all_sources", "documents", lambda d: chunking.chunk(cleaned(d), "doc_id", "text"))
R.add(
    "structure_profile",
    lambda spark, d: chunking.profile(lines(load(spark, d, "documents"))),
    f"SELECT doc_id, count(*) AS parents, sum(n)::BIGINT AS children, quantile_cont(n, 0.5) AS median_children, max(n) AS max_children FROM (SELECT doc_id, parent_no, count(*) AS n FROM ({LINES_SQL}) GROUP BY ALL) GROUP BY doc_id",
)
