"""The stored index, cells, numbering, sketches, models and the smaller retrieval and evaluation pieces."""

import json
import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import analytics, evaluate, lexical_index, models, retrieval, vectors
from corpusloom.plans.base import load
from corpusloom.sources import files
from corpusloom.sources.workspace import work_dir


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in df.collect())


WORDS = ["the", "of", "cat", "dog", "bird", "rare", "x1", "x2", "x3"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=8), min_size=1, max_size=12), st.lists(st.lists(st.sampled_from([*WORDS, "nowhere"]), max_size=5), min_size=1, max_size=4), st.integers(1, 4))
def test_index_gives_what_a_scan_gives(spark, monkeypatch, docs, queries, k):
    monkeypatch.setattr(lexical_index, "FIRST", 3)
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(docs)], "doc_id long, text string")
    q = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(queries)], "query_id long, text string")
    index = lexical_index.build(d, work_dir(spark, "index"), 3)
    assert ranked(index.topk(q, k)) == ranked(retrieval.bm25_topk(q, d, k))


def test_index_is_found_again_and_meets_its_postings_where_they_are(spark):
    d = spark.createDataFrame([(i, f"common word{i % 7} word{i}") for i in range(200)], "doc_id long, text string")
    path = work_dir(spark, "index")
    lexical_index.build(d, path, 5)
    spark.sql(f"DROP TABLE {lexical_index._table(spark, path, 5)}")
    index = lexical_index.LexicalIndex(spark, path)
    assert index.buckets == 5 and index.stats.first()["n"] == 200
    asked = index.postings.select("term", "shard").distinct().hint("merge")
    plan = index.postings.join(asked, ["term", "shard"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    rows = spark.createDataFrame([(1, "common word3")], "query_id long, text string")
    assert ranked(index.topk(rows, 5)) == ranked(retrieval.bm25_topk(rows, d, 5))


def test_all_documents_as_queries_read_few_postings(spark):
    """First sentences of 1,000 documents ask 1,000 documents; reading all hits would be a tenth of all pairs several times over."""
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    index = lexical_index.build(docs, work_dir(spark, "index"))
    queries = docs.select(F.col("doc_id").alias("query_id"), evaluate.first_sentence(F.col("text")).alias("text"))
    assert index.topk(queries, 2).count() > 1900
    assert index.read_rows < 0.1 * 1000 * 1000


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_index_passes_on_k_rows_of_a_query_and_shard(spark, monkeypatch, cells):
    """Every query has words of every document, but no row for each of these pairs is written; shards and slices give the same."""
    monkeypatch.setattr(lexical_index, "SHARD", 700)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    monkeypatch.setattr(lexical_index, "FIRST", 8)
    d = spark.createDataFrame([(i, f"the of word{i % 50} word{i}" + " of" * (i % 7)) for i in range(600)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"the of of word{i} nowhere") for i in range(40)] + [(40, None), (41, "nowhere")], "query_id long, text string")
    index = lexical_index.build(d, work_dir(spark, "index"), 2)
    shards = index.postings.select("shard").distinct().count()
    written, stored = [], lexical_index.stored
    monkeypatch.setattr(lexical_index, "stored", lambda df: written.append(stored(df)) or written[-1])
    assert ranked(index.topk(q, 3)) == ranked(retrieval.bm25_topk(q, d, 3)) and shards > 3
    assert max(x.count() for x in written) <= 40 * 3 * shards + shards
    assert index.topk(q.where("query_id > 39"), 3).count() == 0 == index.topk(q.limit(0), 3).count()
    monkeypatch.setattr(retrieval, "ASKED_BYTES", 64 * 50)
    assert ranked(index.topk(q, 3)) == ranked(retrieval.bm25_topk(q, d, 3))


@pytest.mark.parametrize("cells", [1, 50, 1 << 20])
def test_tasks_score_their_own_documents(spark, sf, monkeypatch, cells):
    """No row for each query and document is dealt; slices, and blocks of queries, give the same."""
    monkeypatch.setattr(retrieval, "CELLS", cells)
    docs = load(spark, sf, "documents").limit(60).unionByName(load(spark, sf, "documents").limit(30).withColumn("doc_id", F.col("doc_id") + 1000)).repartition(5)
    asked = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    for topk in (retrieval.bm25_topk, retrieval.fts_topk):
        got = topk(asked, docs, 4)
        assert "HashAggregate(keys=[query_id" not in got._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, got.collect()))
        with monkeypatch.context() as m:
            m.setattr(retrieval, "ASKED_BYTES", 64 * 500)
            assert rows == sorted(map(tuple, topk(asked, docs, 4).collect())) and len(rows) > 100
    index = retrieval.bm25_index(docs)
    assert ranked(retrieval.bm25_topk(asked, docs, 4)) == ranked(retrieval.bm25_topk(asked, docs, 4, index))


def test_all_documents_ask_without_an_index(spark, sf, monkeypatch):
    """Many queries go in blocks, and copies of a first sentence are asked once; the index gives the same."""
    docs = load(spark, sf, "documents").unionByName(load(spark, sf, "documents").limit(20).withColumn("doc_id", F.col("doc_id") + 1000)).withColumn("text", F.when(F.col("doc_id") != 7, F.col("text")))
    index = lexical_index.build(docs, work_dir(spark, "index"))
    want = sorted(map(tuple, evaluate.hard_negatives(docs, index).collect()))
    monkeypatch.setattr(retrieval, "ASKED_BYTES", 64 * 700)
    monkeypatch.setattr(lexical_index, "build", None)
    assert sorted(map(tuple, evaluate.hard_negatives(docs).collect())) == want and len(want) == 220


def test_documents_are_told_by_any_kind_of_id_and_no_query_asks(spark):
    docs = spark.createDataFrame([("b", "cat"), ("a", "cat"), ("c", None)], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "cat dog"), (2, None)], "query_id long, text string")
    assert [r["doc_id"] for r in retrieval.bm25_topk(asked, docs).orderBy("rank").collect()] == ["a", "b"]
    assert retrieval.bm25_topk(asked.where("text IS NULL"), docs).count() == 0 == retrieval.bm25_topk(asked, docs.limit(0)).count()


@pytest.mark.parametrize("kind", ["hash", "text"])
def test_places_of_hashed_ids(spark, kind):
    ids = spark.range(5000).select(F.xxhash64("id").alias("doc_id")).dropDuplicates()
    ids = ids if kind == "hash" else ids.select(F.md5(F.col("doc_id").cast("string")).alias("doc_id"))
    rows = ids.crossJoin(spark.range(3).withColumnRenamed("id", "no"))
    got = [tuple(r) for r in files.with_global_index(rows, "doc_id", "no").orderBy("global_index").collect()]
    assert [r[2] for r in got] == list(range(len(got))) and [r[:2] for r in got] == sorted(r[:2] for r in got) and len(got) == 15_000


def test_places_of_no_rows_and_of_equal_rows(spark):
    assert files.with_place(spark.range(0), ["id"], "i").count() == 0
    assert sorted(r["i"] for r in files.with_place(spark.range(900).select(F.lit(7).alias("id")), ["id"], "i").collect()) == list(range(900))


def unit(x):
    return [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())]


@pytest.mark.parametrize("shape", ["clusters", "uniform", "one point"])
def test_cells_find_exactly_the_nearest(spark, monkeypatch, shape):
    monkeypatch.setattr(vectors.Cells, "RING_ROWS", 40)
    rng = np.random.default_rng(3)
    x = {"clusters": rng.normal(size=(20, 16))[rng.integers(0, 20, 1500)] * 4 + rng.normal(size=(1500, 16)) * 0.5, "uniform": rng.normal(size=(600, 16)), "one point": np.ones((100, 4)) + rng.normal(size=(100, 4)) * 1e-12}[shape]
    corpus = spark.createDataFrame(unit(x), "id long, vec array<double>")
    asked = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec")
    got = vectors.ann_topk(asked, corpus, 5)
    rows = got.collect()
    want = vectors.dense_topk(asked, corpus, 5, -1.0).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in rows) == sorted((r["query_id"], r["rank"], r["id"]) for r in want)
    if shape == "clusters":
        assert np.mean([r["scored"] for r in rows]) < 0.25 * 1500


def test_cells_of_few_and_no_vectors(spark):
    corpus = spark.createDataFrame(unit(np.eye(3)), "id long, vec array<double>")
    asked = corpus.select(F.col("id").alias("query_id"), "vec")
    assert vectors.ann_topk(asked, corpus, 5).count() == 9
    assert vectors.ann_topk(asked, corpus.limit(0), 5).count() == 0


def test_norms_are_computed_once_a_vector(spark):
    plan = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(vectors.l2_normalize(F.col("v")))
    assert np.allclose(plan.first()[0], [5**-0.5, 2 * 5**-0.5])
    assert plan._jdf.queryExecution().optimizedPlan().toString().split(" AS ")[0].count("aggregate(") == 1


def test_merged_sketches_keep_ranks(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i % 5), f"k{i % 2}", float(v)) for i, v in enumerate(rng.lognormal(0, 2, 20_000))] + [(0, "flat", 1.0)] * 100
    df = spark.createDataFrame(rows, "day int, k string, v double")
    ranks = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    told = analytics.sketched_percentiles(analytics.quantile_sketches(df, ["k", "day"], "v"), ["k"], ranks)
    for r in analytics.rank_errors(df, ["k"], "v", told, ranks).collect():
        assert max(r[c] for c in ranks) <= 0.01
    assert {r["k"]: r["n"] for r in told.collect()} == {"k0": 10_000, "k1": 10_000, "flat": 100}


def lengths(at):
    class Lengths:
        """A model whose load leaves a file for each time, and that notes the sizes of the batches it gets."""

        def __init__(self, folder):
            self.name, self.folder = f"lengths-{folder}", folder

        def load(self):
            open(f"{self.folder}/load-{os.getpid()}-{len(os.listdir(self.folder))}", "w").close()
            return 2.0

        def encode(self, held, texts):
            assert [len(t) for t in texts] == sorted(len(t) for t in texts) and len(texts) <= 16
            return [[held * len(t), 1.0] for t in texts]

        def score(self, held, queries, texts):
            return [held * len(q) + len(t) for q, t in zip(queries, texts, strict=True)]

    return Lengths(at)


def test_models_load_once_a_worker(spark, tmp_path):
    model = lengths(str(tmp_path))
    df = spark.range(400).select("id", F.when(F.col("id") % 50 != 7, F.repeat(F.lit("x"), (F.col("id") % 31).cast("int"))).alias("t")).repartition(12)
    for _ in range(3):
        got = {r["id"]: r["vec"] for r in models.encode(df, "id", "t", model, 16).collect()}
    assert got == {i: [2.0 * (i % 31), 1.0] for i in range(400) if i % 50 != 7}
    loads = [n.split("-")[1] for n in os.listdir(tmp_path)]
    assert len(loads) == len(set(loads)) <= 8
    scored = models.score_pairs(df.withColumn("q", F.lit("ab")), "q", "t", model, 16).collect()
    assert all(r["score"] == (None if r["t"] is None else 4.0 + len(r["t"])) for r in scored)


def test_a_hashing_model_gives_what_the_default_gives(spark):
    import hashlib

    class Hashing:
        name = "hashing"

        def load(self):
            return 64

        def encode(self, dim, texts):
            out = []
            for t in texts:
                v = np.zeros(dim)
                for w in t.split():
                    v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
                out.append(v / np.linalg.norm(v))
            return out

    df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "dogs and cats"), (3, "bird")], "doc_id long, text string")
    ours = {r["doc_id"]: r["vec"] for r in models.encode(df, "doc_id", "text", Hashing()).collect()}
    assert all(np.allclose(ours[r["doc_id"]], r["vec"]) for r in vectors.embed_text(df, "doc_id", "text").collect())


def test_table_function_chunks_like_the_operator(spark, sf):
    from corpusloom.plans.text_queries import R

    both = [sorted(map(tuple, R.queries[n](spark, sf).collect())) for n in ("chunk_lateral", "chunk_recursive")]
    assert both[0] == both[1] and len(both[0]) > 500


def test_contexts_citations_and_sentinels(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    rows = spark.createDataFrame([(1, 2, "B", 8, "u2", "second", None, 0.5), (1, 1, "A", 7, "u1", "first", 0.9, 0.1), (1, 3, "C", None, "u3", "third", None, None)], "query_id long, rank int, source string, doc_id long, url string, text string, cross double, similarity double")
    got = dict(map(tuple, retrieval.build_context(rows.where("doc_id is not null"), None, asked).collect()))
    assert got == {1: "[Source: A (7)]\nfirst\n\n[Source: B (8)]\nsecond", 2: "No relevant context found."}
    web = rows.select("query_id", "rank", F.col("source").alias("title"), F.col("text").alias("snippet"), "url").where("rank = 1")
    assert dict(map(tuple, retrieval.web_context(web, 14, asked).collect())) == {1: "[WEB]: A\nfirst", 2: ""}
    cited = {r["query_id"]: ([tuple(c) for c in r["citations"]], r["parent_ids"]) for r in retrieval.citations(rows, asked).collect()}
    assert cited == {1: ([("A", "u1", 0.9, 7), ("B", "u2", 0.5, 8), ("C", "u3", 0.0, None)], [7, 8]), 2: ([], [])}


@pytest.mark.parametrize(
    "raw, scores",
    [([0.1, 2, 3], [0.1, 2.0]), ([[0.1], [0.9, 5]], [0.1, 0.9]), ([[1], []], [1.0, 0.0]), ([[{"score": 0.3}], [{"x": 1}]], [0.3, 0.0]), ({"scores": [1, 2, 3]}, [1.0, 2.0]), ({"scores": "no"}, None), ([{"score": 1}], None), ([], None), ("text", None), (None, None)],
)
def test_scores_of_a_pair_scorer(spark, raw, scores):
    df = spark.createDataFrame([(json.dumps(raw) if raw != "text" else "text",)], "r string")
    assert df.select(evaluate.parse_pair_scores(F.col("r"), F.lit(2))).first()[0] == scores


def test_measures_of_queries_without_rows(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    ranked = spark.createDataFrame([(1, 0.9, "The CAT"), (1, 0.5, "dog"), (2, 0.1, "x")], "query_id long, cross double, text string")
    assert dict(map(tuple, evaluate.context_precision(asked, ranked).collect())) == {1: 0.5, 2: 0.0, 3: 0.0}
    words = spark.createDataFrame([(1, ["cat", "Dog", "owl", "cat"]), (2, []), (3, ["a"])], "query_id long, words array<string>")
    got = dict(map(tuple, evaluate.keyword_recall(words, ranked).collect()))
    assert abs(got.pop(1) - 2 / 3) < 1e-9 and got == {2: 1.0, 3: 0.0}
    truth = spark.createDataFrame([(1, "the cat sat"), (2, "X"), (3, "y")], "query_id long, truth string")
    assert dict(map(tuple, evaluate.prefix_recall(truth, ranked, 7).collect())) == {1: 1.0, 2: 1.0, 3: 0.0}


def test_engines_side_by_side_join_by_question(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 0.0)], "query_id long, p double")
    b = spark.createDataFrame([(2, 0.0), (1, 1.0)], "query_id long, p double")
    assert [tuple(r) for r in evaluate.side_by_side({"a": a, "b": b}, ["p"]).collect()] == [("p", 0.75, 0.5, -0.25)]


def test_day_labels(spark):
    days = ["2024-01-31", "2024-01-30", "2024-01-26", "2024-01-24", "2023-12-05", "not a day", None]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    assert [r[0] for r in df.select(analytics.day_label(F.col("d"), F.expr("timestamp '2024-01-31 05:00:00'"))).collect()] == ["Today", "Yesterday", "Fri", "Jan 24", "Dec 5", "not a day", None]


def test_batch_manifests_as_array_or_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"url": "u1", "title": "t"}, {"pdf": "p1"}, "u2", {"other": 1}]))
    (tmp_path / "b.txt").write_text('# list\n\nhttp://u3\r\n"u4"\n{"url": "u5"}\n7\n')
    got = sorted((r["kind"], r["value"]) for r in files.parse_batch_manifest(spark, f"file://{tmp_path}").collect())
    assert got == [("pdf", "p1"), ("url", "http://u3"), ("url", "u1"), ("url", "u2"), ("url", "u4"), ("url", "u5")]
