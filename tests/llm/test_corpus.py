"""Exact dedup, bag search and collocations: against SQL, and against plain Python on awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_oracles import TABLES, plain

from corpusloom.llm import bag_search, collocations, exact_dedup
from corpusloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and plain(ours) == plain(theirs)


# exact dedup


def sha(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).digest()


def added(spark, index, rows, batch="0"):
    df = exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(batch))
    index.add(df)
    return {(r["id"], bytes(r["digest"])): (r["keep_id"], r["kept"], r["group_size"]) for r in index.resolve(df).collect()}


def test_digests_ignore_kinds_of_white_space(spark):
    df = spark.createDataFrame([("a \t\n b",), ("a b",), (" a b",), ("a\x85b",), (None,), ("",), ("\x0b",)], "t string")
    assert [bytes(r[0]) for r in df.select(exact_dedup.digest(F.col("t"))).collect()] == [sha(t) for t in ("a b", "a b", " a b", "a\x85b", "", "", " ")]


def test_index_outlives_batches_and_repeats_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 3)
    first = [(5, "x"), (4, "x "), (3, "x"), (None, "n"), (9, None), (8, "")]
    want = {(5, sha("x")): (3, False, 2), (4, sha("x ")): (4, True, 1), (3, sha("x")): (3, True, 2), (None, sha("n")): (None, True, 1), (9, sha("")): (8, False, 2), (8, sha("")): (8, True, 2)}
    assert added(spark, index, first) == want
    spark.sql(f"DROP TABLE {index.name}")
    again = exact_dedup.DigestIndex(spark, path)
    assert again.buckets == 3 and again.read().count() == 4
    assert added(spark, again, [(1, "x"), (2, "new")], "1") == {(1, sha("x")): (3, False, 1), (2, sha("new")): (2, True, 1)}
    before = sorted(map(str, again.read().collect()))
    added(spark, again, [(1, "x"), (2, "new")], "2")
    assert sorted(map(str, again.read().collect())) == before


def test_the_index_is_merged_without_being_dealt(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 5)
    added(spark, index, [(i, f"t{i}") for i in range(50)])
    batch = spark.range(60).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")).repartition(5, "digest").hint("merge")
    plan = batch.join(index.read().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(digest") == 1


def test_one_of_a_third_of_all_rows_and_of_repeated_rows_stays(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    rows = [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(3000)] + [(7, "t7")]
    df = exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), F.lit("0"))
    index.add(df)
    out = index.resolve(df)
    assert out.count() == 3001 and out.where("kept").count() == 2001 and out.where("kept AND id = 7").count() == 1
    assert out.where("group_size = 1000 AND keep_id = 0").count() == 1000


def test_exact_dedup_awkward_rows(spark, edge, nothing, tmp_path):
    for i, (df, n) in enumerate(((edge, edge.count()), (nothing, 0))):
        rows = exact_dedup.digests(df, F.lit("0"))
        index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/{i}", 2)
        index.add(rows)
        out = index.resolve(rows).collect()
        assert len(out) == n and sum(r["kept"] for r in out) == len({bytes(r["digest"]) for r in out})


# bag search


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(x for *_, x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b, size in bags:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


DOCS = [(1, "The cat sat"), (2, "the CAT sat"), (3, "sat the cat"), (4, "cat cat dog"), (5, None), (6, ""), (7, "?! --"), (8, "über dog Ünder"), (None, "the cat sat"), (9, "the cat sat"), (9, "the cat sat"), (10, "unrelated " * 50)]
ITEMS = [(1, "cat sat cat"), (2, "dog über"), (3, None), (4, "nowhere"), (1, "cat sat cat"), (None, "the")]


@pytest.mark.parametrize("k, bytes_", [(10, 4 << 20), (3, 4 << 20), (3, 8)])
def test_bag_search_against_the_formula(spark, monkeypatch, k, bytes_):
    monkeypatch.setattr(bag_search, "PART_BYTES", bytes_)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("bag", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(0))
    assert sorted(str(tuple(r)) for r in bag_search.search(docs, items, k).collect()) == brute_search(DOCS, ITEMS, k)


def test_bag_search_in_many_small_cells(spark, texts, monkeypatch):
    """Small slices, cuts of what a task keeps, and the other way of adding up give the same."""
    docs = [(d, t[:400]) for d, t, _ in texts]
    items = [(i, t[:200]) for i, t, _ in texts[:30]]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items)
    for cells, most in ((64, 5), (1 << 20, 10**6)):
        monkeypatch.setattr(bag_search, "CELLS", cells)
        assert sorted(str(tuple(r)) for r in bag_search.search(*frames).collect()) == want


def test_a_class_of_many_copies_gives_its_smallest_ids(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "common words here").otherwise(F.concat(F.lit("other "), "id")).alias("text"))
    items = spark.createDataFrame([(1, "common words")], "item_id long, text string")
    assert [r["doc_id"] for r in bag_search.search(docs, items, 5).orderBy("rank").collect()] == [0, 3, 6, 9, 12]


def test_bag_search_awkward_rows(spark, edge, nothing):
    items = spark.createDataFrame([(1, "one two w1x1")], "item_id long, text string")
    assert {r["doc_id"] for r in bag_search.search(edge, items).collect()} == {4, 5, 6, 7}
    assert bag_search.search(nothing, items).count() == 0 and bag_search.search(edge, items.limit(0)).count() == 0


# collocations


def brute_collocations(docs, longest, least, covered=50, first=2000):
    out = []
    f = defaultdict(Counter)
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang or "und"][tuple(ws[i : i + k])] += 1
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        candidates = {g: v for g, v in c.items() if len(g) > 1 and v >= least}
        rows = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and 100 * b >= covered * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in candidates.items()):
                continue
            score, k = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def ours(df, *args, **more):
    return sorted(map(tuple, collocations.collocations(df, *args, **more).collect()))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["en", None, "de"]), st.text(alphabet="ab B\t.\n", max_size=60)), min_size=1, max_size=6), st.sampled_from([(3, 2), (4, 2), (2, 1)]))
def test_collocations_against_plain_counts(spark, docs, sizes):
    assert ours(spark.createDataFrame(docs, "lang string, text string"), *sizes) == brute_collocations(docs, *sizes)


def test_collocations_of_long_repeated_passages(spark):
    """Unary paths of hundreds of words, crossing and nested ones, and piece ends in the middle."""
    long = " ".join(f"w{i}" for i in range(300))
    docs = [("en", long)] * 4 + [("en", " ".join(f"w{i}" for i in range(100, 180)) + ". x y z")] * 3 + [("en", "w150 w151 q"), ("en", "a a a a a a"), ("de", "x y. y z, x y z")] + [("de", "p q r p q r p q r")] * 3
    df = spark.createDataFrame(docs, "lang string, text string")
    for sizes in ((3, 2), (4, 3)):
        assert ours(df, *sizes) == brute_collocations(docs, *sizes)


def test_paths_hold_every_frequent_edge_once(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PATH", 7)
    docs = [("en", " ".join(f"w{i}" for i in range(60)))] * 3 + [("en", "x w20 w21 w22 y")] * 2
    grams = collocations.counts(spark.createDataFrame(docs, "lang string, text string"), 3, 2).cache()
    rows = collocations.compacted(collocations.paths(grams)).collect()
    found = Counter()
    for r in rows:
        ws = r["text"].split(" ")
        assert len(ws) <= 9
        for i in range(len(ws) - 2):
            found[" ".join(ws[i : i + 3])] += r["n"]
    assert found == {r["gram"]: r["n"] for r in grams.where("words = 3").collect()}
    assert len({r["path"] for r in rows}) == 5


def test_collocations_awkward_rows(spark, edge, nothing, monkeypatch):
    monkeypatch.setattr(collocations, "FLUSH", 50)
    rows = [(r["lang"], r["text"]) for r in edge.collect()]
    assert ours(edge, 3, 2) == brute_collocations(rows, 3, 2)
    assert ours(nothing) == []


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(4 * 10**14, 5 * 10**14, 6 * 10**14)], "a long, l long, r long")
    assert df.select(collocations.score("a", "l", "r")).first()[0] == 10**6 * 16 // 30
