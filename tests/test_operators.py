"""Operators on small cases with known results."""

import math
import random
import time
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import analytics as A
from corpusloom.operators import cache as C
from corpusloom.operators import chunking, evaluate, pruned, retrieval, sync, vectors
from corpusloom.streaming import jobs

DOCS = [(1, "the cat sat on the mat"), (2, "dogs and cats"), (3, "cat cat cat dog"), (4, None), (5, "bird")]
QUERIES = [(10, "cat dog"), (11, "cat cat"), (12, "nothing here"), (13, None)]


def brute_bm25(k=15):
    docs = {d: t.split() if t else [] for d, t in DOCS}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = []
    for q, text in QUERIES:
        scores = {}
        for d, ws in docs.items():
            s = 0.0
            for t in (text or "").split():
                tf, df = ws.count(t), sum(t in x for x in docs.values())
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / mean)) if tf else 0.0
            if round(s, 9) > 0:
                scores[d] = round(s, 9)
        out += [(q, d, s, i + 1) for i, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string"), spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.mark.parametrize("stored", [False, True])
def test_bm25_against_the_formula(spark, tables, tmp_path, stored):
    queries, docs = tables
    index = None
    if stored:
        retrieval.bm25_index(docs).write.parquet(str(tmp_path / "index"))
        index = spark.read.parquet(str(tmp_path / "index"))
    got = sorted(map(tuple, retrieval.bm25_topk(queries, docs, index=index).collect()))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in brute_bm25()] and np.allclose([g[2] for g in got], [w[2] for w in brute_bm25()])


def test_full_text_counts_are_whole_numbers(spark):
    """14 terms found 104 times stay 104: rounded to nine places, 14 * 2**32 + 104 falls below itself."""
    terms = [f"word{i}" for i in range(14)]
    docs = spark.createDataFrame([(i, " ".join(terms + ["word0"] * i)) for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(terms))], "query_id long, text string")
    got = retrieval.fts_topk(asked, docs, 200).orderBy("rank").collect()
    assert [(r["doc_id"], r["matched"], r["tf"]) for r in got] == [(i, 14, 14 + i) for i in range(199, -1, -1)]


def test_engine_ranks_by_whole_counts(spark):
    """Both documents hold all 14 terms, one of them once more often; the larger number stands first, whatever its id."""
    terms = [f"word{i}" for i in range(14)]
    docs = spark.createDataFrame([(i, " ".join(terms + ["word0"] * i)) for i in (89, 90)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(terms))], "query_id long, text string")
    got = retrieval.sparse_topk(asked, docs).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(1, 90, 1, "fts"), (1, 89, 2, "fts")]


def test_overlap_with_a_cut_between_whole_counts(spark):
    """Full text's first is the document with one occurrence more, which the other engine has too."""
    terms = [f"word{i}" for i in range(14)]
    docs = spark.createDataFrame([(i, " ".join(terms + ["word0"] * i)) for i in (89, 90)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(terms))], "query_id long, text string")
    ranked = spark.createDataFrame([(1, 90, 1)], "query_id long, doc_id long, rank int")
    assert [tuple(r) for r in retrieval.overlap(ranked, retrieval.fts_topk(asked, docs, 1)).collect()] == [(1, 1, 1)]


@pytest.mark.parametrize("terms", [0, 3, 1000])
def test_index_deals_no_postings_of_frequent_terms(spark, monkeypatch, terms):
    """None at all if the broadcast holds all terms. Rows of one id are one document; one without id counts, but isn't told of."""
    monkeypatch.setattr(retrieval, "ASKED_BYTES", 64 * terms)
    rows = [(1, "the cat the"), (2, "the dog"), (1, "the owl cat"), (3, None), (4, ""), (None, "the fox"), (5, "the-cat of cat")]
    got = retrieval.bm25_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert terms < 1000 or "hashpartitioning" not in plan
    docs = {}
    for d, t in rows:
        docs.setdefault(d, []).extend((t or "").split())
    df = {w: sum(w in ws for ws in docs.values()) for ws in docs.values() for w in ws}
    want = sorted((d, w, ws.count(w), df[w], len(ws)) for d, ws in docs.items() if d for w in set(ws))
    assert sorted((r["doc_id"], r["term"], r["tf"], r["df"], r["len"]) for r in got.collect()) == want
    mean = sum(map(len, docs.values())) / len(rows)
    assert all(abs(r["avgdl"] - mean) < 1e-9 and abs(r["idf"] - math.log(1 + (7 - r["df"] + 0.5) / (r["df"] + 0.5))) < 1e-9 for r in got.collect())
    assert retrieval.bm25_index(got.select("doc_id", F.lit(None).cast("string").alias("text")).limit(0)).count() == 0


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("k", [1, 3])
def test_pruned_search_gives_what_a_scan_gives(spark, monkeypatch, small, k):
    """Frequent and rare words, copies, empty texts, words said often; slices, classes, chunks, blocks and groups of any size give the same."""
    if small:
        for name, value in {"HELD": 300, "CLASSES": 5, "CHUNK": 20, "ROWS": 150, "WORDS": 100, "SEEDS": 2, "HEAVIEST": 1}.items():
            monkeypatch.setattr(pruned, name, value)
        monkeypatch.setattr(retrieval, "CELLS", 50)
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 150}" for _ in range(rng.choice([0, 1, 3, 10, 40, 150]))) for _ in range(250)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:20] + [None])), "doc_id long, text string").repartition(3)
    asked = docs.select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 30).alias("text")).unionByName(spark.createDataFrame([(1000, "nowhere w1 w1 w2"), (1001, "nowhere")], "query_id long, text string"))
    ours, theirs = (sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in f(asked, docs, k).collect()) for f in (pruned.bm25_topk, retrieval.bm25_topk))
    assert ours == theirs and len(ours) > 200
    assert pruned.bm25_topk(asked.limit(0), docs, k).count() == 0 == pruned.bm25_topk(asked, docs.limit(0), k).count()


def test_hard_negatives_split_texts_once(spark, sf, monkeypatch):
    """However many blocks the first sentences make."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(retrieval, "ASKED_BYTES", 64 * 300)
    monkeypatch.setattr(pruned, "ROWS", 300)
    split, numbered = [], retrieval._numbered
    monkeypatch.setattr(retrieval, "_numbered", lambda *a: split.append(1) or numbered(*a))
    assert evaluate.hard_negatives(docs).count() == docs.count() and len(split) == 1


def test_pruned_search_reads_few_postings(monkeypatch):
    """3,000 documents hold the same ten words and one rare one each three of them share; a query of all eleven reads next to nothing but its three."""
    n = 3000
    term = np.concatenate([np.append(np.arange(10), 10 + i % 1000) for i in range(n)])
    times = np.append(np.full(10, 0.01), 6.0)
    asked = pruned._Asked(np.arange(n + 1) * 11, term, np.tile(times, n), 1010)
    read, runs = [], pruned._runs
    monkeypatch.setattr(pruned, "_runs", lambda first, many: read.append(int(many.sum())) or runs(first, many))
    query, score, doc = pruned._above(asked, pruned._Floor(np.full(n, 6.0), 2), 4, 1 << 18, 1 << 20, np.full(n, 11), term, np.ones(11 * n))
    assert sorted(zip(query.tolist(), doc.tolist(), strict=True)) == sorted((q, d) for q in range(n) for d in range(q % 1000, n, 1000))
    assert np.allclose(score, 6.1) and sum(read) < 0.01 * n * n * 11


def test_hooks_replace_tokenizer_scorer_and_encoder(spark, tables):
    queries, docs = tables
    whole = lambda c: F.array(c)
    assert retrieval.bm25_topk(spark.createDataFrame([(1, "bird")], "query_id long, text string"), docs, tokenizer=whole).select("doc_id").collect() == [(5,)]
    fused = docs.select(F.lit(10).cast("long").alias("query_id"), "doc_id", F.lit(0.1).alias("rrf"), F.col("doc_id").alias("rank"))
    ranked = retrieval.rerank_topk(fused, queries, docs, k=2, scorer=lambda text, q: F.length(text).cast("double"))
    assert [(r["doc_id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [(1, 1), (3, 2)]
    encoded = vectors.embed_text(docs, "doc_id", "text", encoder=lambda c: F.array(F.length(c).cast("double"), F.lit(0.0)))
    assert {r["doc_id"]: r["vec"] for r in encoded.where("doc_id = 1").collect()} == {1: [1.0, 0.0]}


def test_rrf_adds_a_sixty_first(spark):
    lists = spark.createDataFrame([(1, 0, 1, 7), (1, 1, 1, 7), (1, 0, 2, 8), (1, 1, 2, 9)], "query_id long, list_id int, rank int, doc_id long")
    got = retrieval.rrf_fuse(lists).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [7, 8, 9] and abs(got[0]["rrf"] - 2 / 61) < 1e-9 and abs(got[1]["rrf"] - 1 / 62) < 1e-9


def test_dense_blocks_give_what_one_broadcast_gives(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(300, 8))
    rows = [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = corpus.select(F.col("id").alias("query_id"), "vec")
    once = sorted(map(tuple, vectors.dense_topk(asked, corpus, 5, -1.0, other_only=True).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 50)
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 70)
    assert sorted(map(tuple, vectors.dense_topk(asked, corpus, 5, -1.0, other_only=True).collect())) == once and len(once) == 1500
    s = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(s, -9)
    assert all(r[1] == int(np.argsort(-s[r[0]])[r[3] - 1]) for r in once)


def test_ann_recall(spark):
    """Against exact search: the share of its 15 best that are found."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), vectors.l2_normalize(F.col("embedding")).alias("vec"))
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec")
    best, found = ({(r[0], r[1]) for r in f(asked, df).select("query_id", "id").collect()} for f in (lambda q, c: vectors.dense_topk(q, c, 15, -1.0), vectors.ann_topk))
    assert len(best & found) >= 0.9 * len(best)


def test_next_answer_of_one_busy_key(spark):
    """200,000 rows under one key take seconds, as the frame only grows."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"), "id")
    began = time.time()
    out = A.next_answer(df, "k", "ts", "id", F.col("id") % 3 == 0, {"v": F.col("id")})
    got = out.where("id % 3 <> 0").agg(F.sum(F.col("answer.id") - F.col("id")), F.count("answer")).first()
    assert tuple(got) == (199_998, 133_332) and time.time() - began < 60


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 6), st.booleans()), min_size=1, max_size=12), st.booleans())
def test_next_answer_is_the_earliest_later_one(spark, rows, strict):
    data = [(i, k, t, a) for i, (k, t, a) in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, k int, t int, a boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: r["x"] for r in A.next_answer(df, "k", "ts", "id", F.col("a"), {}, strict).select("id", F.col("answer.id").alias("x")).collect()}
    for i, k, t, _ in data:
        later = [(u, j) for j, m, u, b in data if m == k and b and (u > t or not strict and u == t)]
        assert got[i] == (min(later)[1] if later else None)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=400), st.integers(10, 80), st.integers(2, 9))
def test_chunks_keep_their_bounds_and_order(text, size, overlap):
    chunks = chunking.split_text(text, size, overlap, 1)
    for c in chunks:
        assert 1 <= len(c) <= size + overlap + 2 and c == c.strip() and c in text
    for letter in "ab":
        assert sum(c.count(letter) for c in chunks) >= text.count(letter)


def test_short_texts_are_one_chunk_and_long_words_are_cut():
    assert chunking.split_text("one short text", 600, 150, 5) == ["one short text"]
    assert chunking.split_text("", 600, 150, 5) == []
    assert all(len(c) <= 755 for c in chunking.split_text("x" * 5000, 600, 150, 100))


def test_parents_and_children(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = chunking.parent_child(docs, "doc_id", "text").collect()
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    for r in rows:
        assert r["text"] in r["parent_text"] and (len(r["text"]) >= 40 or r["text"] == r["parent_text"])


def test_nfc(spark):
    texts = ["e\u0301", "plain", None, "A\u030a \u00c5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(chunking.normalise("t")).collect()] == [unicodedata.normalize("NFC", t) if t else None for t in texts]


@pytest.mark.parametrize(
    "text, masked",
    [
        ("DE89370400440532013000", "[IBAN_REDACTED]"), ("DE89 3704 0044 0532 0130 00", "[IBAN_REDACTED]"), ("mail a.b@c.org now", "mail [EMAIL_REDACTED] now"),
        ("born 01.02.1980", "born [DOB_REDACTED]"), ("1980-02-01", "[DOB_REDACTED]"), ("call +49 170 1234567", "call [PHONE_REDACTED]"), ("C01X00T47 and L01234567", None),
        ("nothing to hide 12", "nothing to hide 12"), (None, None), ("", ""),
    ],
)
def test_personal_data(spark, text, masked):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.mask_pii(F.col("t"))).first()[0]
    if masked is not None or text is None:
        assert got == masked
    slow = text
    if text is not None:
        c = F.col("t")
        for _, pattern, mark in T.PII:
            c = F.regexp_replace(c, pattern, mark)
        slow = df.select(c).first()[0]
    assert got == slow


def test_html_keeps_the_text_and_drops_the_rest(spark):
    html = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><nav>menu</nav><main><p>First line.</p><script>var x;</script><p>Second &lt;line&gt;.</p></main></body></html>"
    row = spark.createDataFrame([(html,), (None,)], "h string").select(T.html_title(F.col("h")).alias("t"), T.html_text(T.html_region(F.col("h"))).alias("x")).collect()
    assert row[0]["t"] == "A & B" and "First line." in row[0]["x"] and "Second <line>." in row[0]["x"] and "var x" not in row[0]["x"]


def test_cache_tiers(spark):
    cache = spark.createDataFrame([(1, "h1", [1.0, 0.0], 9), (2, "h2", [0.0, 1.0], 1)], "entry_id long, query_hash string, vec array<double>, expires_at int")
    probes = spark.createDataFrame([(10, "fine", "h1", [1.0, 0.0]), (11, "fine", "hx", [1.0, 0.0]), (12, "fine", "h2", [0.0, 1.0]), (13, "wrong answer", "h1", [1.0, 0.0]), (14, "fine", "hz", None)], "query_id long, text string, query_hash string, vec array<double>")
    got = dict(map(tuple, C.lookup_tiered(probes, cache, F.lit(5), ("wrong",)).collect()))
    assert got == {10: "exact", 11: "similar", 12: "miss", 13: "negative", 14: "miss"}


def test_jobs_are_requeued_failed_and_dropped(spark):
    at = F.expr("timestamp '2024-01-02 00:00:00'")
    rows = [(1, "u1", "RUNNING", 0, 30), (2, "u2", "RUNNING", 3, 30), (3, "u3", "RUNNING", 0, 5), (4, "u4", "DONE", 0, 60 * 30), (5, "u5", "QUEUED", 0, 1), (6, "u5", "QUEUED", 0, 1)]
    df = spark.createDataFrame(rows, "id int, url string, status string, attempts int, m int")
    ts = F.expr("timestamp '2024-01-02 00:00:00' - make_dt_interval(0, 0, m)")
    got = dict(map(tuple, sync.reconcile_jobs(df.withColumn("started_at", ts).withColumn("finished_at", ts), at).select("id", "status").collect()))
    assert got == {1: "QUEUED", 2: "FAILED", 3: "RUNNING", 5: "QUEUED"}


def test_rate_limits_against_a_plain_log(spark):
    rng = random.Random(3)
    rows = sorted((rng.randint(0, 500), i, rng.randint(0, 2)) for i in range(200))
    df = spark.createDataFrame([(i, k, t) for t, i, k in rows], "event_id long, k int, t int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["event_id"]: (r["admitted"], r["remaining"]) for r in jobs.rate_limit_audit(df, "k", 3, 60.0).collect()}
    logs = {k: [] for k in range(3)}
    for t, i, k in rows:
        logs[k] = [x for x in logs[k] if x > t - 60]
        ok = len(logs[k]) < 3
        if ok:
            logs[k].append(t)
        assert got[i] == (ok, 3 - len(logs[k]))
