"""Nearest neighbours and decontamination against brute force, and the pipeline as a whole."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import ann, decontaminate
from corpusloom.llm.license_scan import split


def brute_nearest(rows, k=20, every=20):
    ids = np.array([i for i, _ in rows])
    width = max(len(v) for _, v in rows)
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def recall(found, truth):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(got[q] & set(t)) / len(t) for q, t in truth.items()])


def test_recall_on_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    found = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert recall(found, brute_nearest(rows)) >= 0.9
    x = {i: np.array(v, dtype=np.float64) for i, v in rows}
    assert all(abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-12 for r in found)


def test_recall_where_blocks_see_little(spark, monkeypatch):
    """Small blocks stand for a large table: what a block fetches is a small part of all vectors."""
    monkeypatch.setattr(ann, "BLOCK", 8)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 1)
    x = np.random.default_rng(5).normal(size=(4000, 32))
    rows = [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert recall(found, brute_nearest(rows, every=100)) >= 0.9


@pytest.mark.parametrize("sent", [0, 32 << 20])
def test_blocks_fetch_lists_and_no_row_for_each_vector(spark, monkeypatch, sent):
    """A round joins a row for each sampled edge at most, whether vectors are sent whole or travel in the lists."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "BROADCAST_BYTES", sent)
    x = np.random.default_rng(6).normal(size=(1200, 16))
    rows = [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())]
    joined, asked = [], ann._asked
    monkeypatch.setattr(ann, "_asked", lambda wanted, bundles: joined.append(asked(wanted, bundles).count()) or asked(wanted, bundles))
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert recall(found, brute_nearest(rows)) >= 0.9
    assert len(joined) > 2 and max(joined) <= 2.5 * ann.SAMPLE * len(rows)


def test_copies_ties_and_norms(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=8) * rng.uniform(0.1, 3)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]
    rows += [(2007, [1.0] * 9), (2008, [3.0])]
    bad = [(2001, None), (2002, []), (2003, [0.0] * 8), (2004, [float("nan")] * 8), (2005, [None] + [1.0] * 7), (2006, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("block", F.lit("x"))
    found = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    truth = brute_nearest(rows)
    assert recall(found, truth) >= 0.9
    mine = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 1020]
    assert mine == truth[1020] and not {r["vec_id"] for r in found} & {b[0] for b in bad}


def test_the_exact_way_finds_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    x = np.random.default_rng(3).normal(size=(700, 6))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, whole=True).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute_nearest(rows)


@pytest.mark.parametrize("length", [10.0, 1e3, 1e5, 1e10, 1e200])
def test_one_long_vector_hides_nothing(spark, monkeypatch, length):
    """With graphs: blocks of 64 vectors, so bands of more than 256 have one."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    x = np.random.default_rng(7).normal(size=(2000, 32))
    x[11] *= length / np.linalg.norm(x[11])
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert len(found) == 2000 and recall(found, brute_nearest(rows)) >= 0.9


def test_norms_of_many_sizes(spark, monkeypatch):
    """Norms over ten powers of ten, a band each for every factor of two."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 8)) * 10.0 ** rng.integers(0, 3, size=(1500, 1))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert recall(found, brute_nearest(rows)) >= 0.9


@pytest.mark.parametrize("size", [1e-200, 1e-320, 1e150, 1e200])
def test_very_small_and_very_large_numbers(spark, size):
    """Scores are the doubles that the products give: 0 and ties below their range, infinity above it."""
    x = np.random.default_rng(9).normal(size=(60, 4))
    x[x == 0] = 1
    rows = [(i, [float(n) for n in v]) for i, v in enumerate((np.sign(x) * np.maximum(np.abs(x), 0.5)) * size)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert len(found) == 60
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q, mine in got.items():
        def total(v):
            s = 0.0
            for a, b in zip(rows[q][1], v):
                with np.errstate(all="ignore"):
                    s = s + a * b
            return s
        order = sorted(((math.isnan(s), -s if not math.isnan(s) else 0.0, i, s) for i, v in rows if i != q for s in [total(v)]))[:20]
        assert [i for i, _ in mine] == [i for *_, i, _ in order], (q, mine, order)
        assert all(a == b or math.isnan(a) and math.isnan(b) for (_, a), (*_, b) in zip(mine, order))


def test_long_and_normal_vectors_together(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(200, 4)).tolist())] + [(200, [1e200, 0.0, 0.0, 0.0]), (201, [0.0, 1e-200, 0.0, 0.0]), (220, [0.0, -1e180, 0.0, 1.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"] for r in found} == {i for i, _ in rows if i % 20 == 0} and len(found) == 20 * 12
    first = {r["query_id"]: r["vec_id"] for r in found if r["rank"] == 1}
    for i, v in rows:
        if i % 20 == 0 and i < 200:
            assert first[i] == (200 if v[0] > 0 else 220 if v[1] < 0 else first[i])


@pytest.mark.parametrize("n", [30, 1200])
def test_tables_of_any_size_are_searched_by_graph(spark, monkeypatch, n):
    monkeypatch.setattr(ann, "exact", None)
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(n).normal(size=(n, 8)).tolist())]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert recall(found, brute_nearest(rows)) >= 0.99


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(few, F.lit(False)).count() == 0


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute_found(item, text):
    """Whether any passage of the text holds the item by the stated rule, without an index."""
    question, answer = decontaminate.question_answer(item)
    ws, doc = question + answer, split(text)
    k = min(5, len(ws))
    stride = max(64, 64 << max(0, (len(ws) - 1) // 64).bit_length() >> 1) if len(ws) > 64 else 64
    enough = lambda q, a: q >= 0.5 * len(question) and a >= 0.5 * len(answer)
    for start in range(0, max(1, -(-len(doc) // stride) - 1) * stride, stride):
        part = doc[start : start + 2 * stride]
        runs = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
        held = [tuple(ws[i : i + k]) in runs for i in range(len(ws) - k + 1)]
        if sum(held) >= 0.75 * len(held):
            covered = {i + j for i, h in enumerate(held) if h for j in range(k)}
            if enough(sum(i < len(question) for i in covered), sum(i >= len(question) for i in covered)):
                return True
        if len(set(part) & set(ws)) >= 0.5 * len(set(ws)):
            n, q = common_length(ws, part), common_length(question, part)
            if n >= 0.75 * len(ws) and enough(q, n - q):
                return True
    return False


def test_leaks_of_whole_table(spark, texts, sf):
    """The query's items are those of a search of every passage for every item, no more and no fewer."""
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontaminate.op8_decontaminate(spark, sf).collect()}
    vocabulary = {i: set(split(t)) for i, t in items.items()}
    assert max(len(split(t)) for t in items.values()) <= 64
    for d, t, _ in texts:
        held = set(split(t))
        # 3/4 of the words in order need 1/2 of the distinct ones at least here
        assert {i for i, x in items.items() if len(vocabulary[i] & held) >= 0.5 * len(vocabulary[i]) and brute_found(x, t)} == got[d]
    assert sum(map(bool, got.values())) < 0.2 * len(got)


def test_planted_and_edited_items(spark, edge, nothing):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    item = [rng.choice(vocabulary, 40).tolist() for _ in range(30)]
    long = rng.choice(vocabulary, 700).tolist()
    told = [(i, " ".join(w[:30]) + ". " + " ".join(w[30:]) + ".") for i, w in enumerate(item)]
    items = spark.createDataFrame(told + [(50, " ".join(long[:600]) + ". " + " ".join(long[600:])), (99, None), (98, "")], "item_id long, text string")
    noise = lambda n: rng.choice(vocabulary, n).tolist()
    edited = list(item[4])
    edited[10], edited[25] = "changed", "also"
    spread = [w for i, w in enumerate(item[6]) for w in ([w, "put", "in"] if i % 4 == 3 else [w])]
    docs = [
        (0, noise(500) + item[3] + noise(500)), (1, noise(200) + edited + noise(90)), (2, noise(1500)), (3, item[7][:15] + noise(300)), (4, noise(63) + item[9]),
        (5, noise(100) + item[5][:30] + noise(200)), (6, noise(40) + spread), (7, noise(333) + long + noise(50)), (8, item[8][25:] + noise(10)),
    ]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").withColumn("found_items", F.lit("theirs"))
    got = {r["doc_id"]: [x["item_id"] for x in r["mine"]] for r in decontaminate.annotate(df, items, to="mine").collect()}
    assert got == {0: [3], 1: [4], 2: [], 3: [], 4: [9], 5: [], 6: [6], 7: [50], 8: []}
    assert decontaminate.annotate(edge, items).count() == edge.count()
    assert decontaminate.annotate(nothing, items).count() == 0
    assert decontaminate.annotate(df, items.limit(0)).where("size(found_items) > 0").count() == 0


def test_stage_keeps_columns_of_any_name(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    df = spark.createDataFrame([(1, "x " + item, 5), (2, "clean text", 6), (2, None, 7)], "doc_id long, text string, found_items int")
    kept = decontaminate.stage(spark, df, sf)
    assert sorted((r["doc_id"], r["found_items"]) for r in kept.collect()) == [(2, 6), (2, 7)] and kept.columns == df.columns


def test_a_question_without_its_answer_is_no_leak():
    question, answer = [f"q{i}" for i in range(40)], ["forty", "two", "litres"]
    index = decontaminate.Index([(1, " ".join(question) + ". " + " ".join(answer))], dict.fromkeys([w.encode() for w in question + answer], 1), 1, 43.0)
    assert index.find([[w.encode() for w in question]]) == [{}]
    assert set(index.find([[w.encode() for w in question + answer]])[0]) == {0}


def test_pruning_hides_nothing():
    rng = np.random.default_rng(9)
    vocabulary = [b"t%d" % i for i in range(200)]
    share = 1 / np.arange(1, 201)
    draw = lambda n: rng.choice(vocabulary, n, p=share / share.sum())
    texts = [b" ".join(draw(12)).decode() for _ in range(60)]
    df = {}
    for t in texts:
        for w in set(split(t)):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.Index(list(enumerate(texts)), df, len(texts), 12.0)
    docs = [np.array([index.vocabulary[w] for w in draw(n).tolist()], np.int32) for n in (300, 64, 10, 129, 5)]
    weight = {(t, int(i)): w for t in range(len(index.start) - 1) for i, w in zip(index.item[index.start[t] : index.start[t + 1]], index.weight[index.start[t] : index.start[t + 1]], strict=True)}
    want = set()
    for d, ws in enumerate(docs):
        for k in range(max(1, -(-len(ws) // index.stride) - 1)):
            held = set(ws[k * index.stride : (k + 2) * index.stride].tolist())
            want |= {(d, k * index.stride, i) for i in range(60) if sum(weight.get((t, i), 0) for t in held) >= 1 - 1e-9}
    assert {r[:3] for r in index.retrieve(docs)} == want and want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=14), st.lists(st.integers(-1, 5), max_size=20), st.data())
def test_words_in_order(ws, passage, data):
    q = data.draw(st.integers(0, len(ws)))
    got = decontaminate.in_order(np.array(ws, np.int32), np.array(passage, np.int32), q)
    assert sum(got) == common_length(ws, passage) and got[0] == common_length(ws[:q], passage)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 9), st.integers(1, 4)), min_size=1, max_size=8))
def test_least_share_bounds_every_choice(weights):
    """No choice of whole occurrences to lose, up to a quarter of all, leaves less of the score."""
    n = sum(k for _, k in weights)
    least = decontaminate.least_share(weights, n)
    lost = max(sum(w for w, g in zip((w for w, _ in weights), gone, strict=True) if g) for gone in itertools.product((0, 1), repeat=len(weights)) if sum(k for (_, k), g in zip(weights, gone, strict=True) if g) <= n * 0.25)
    assert least <= 1 - lost / sum(w for w, _ in weights) + 1e-9


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns and 0 < after.count() <= kept.count()
        kept = after
    packed = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}
