from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import near_dedup as N
from corpusloom.llm.words import shingles, words


def sets(rows):
    out = {}
    for d, t, *_ in rows:
        w = words(t)
        k = min(5, len(w))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    return out


def brute(rows):
    s = sets(rows)
    parent = {d: d for d in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(s):
        shared = Counter(e for g in s[d] for e in holders[g])
        for g in s[d]:
            holders[g].append(d)
        for e, n in shared.items():
            if 100 * n >= 75 * (len(s[d]) + len(s[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s[d]), root(d)) for d in s}


def test_same_components_as_brute_force(spark, sf, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.op1_near_dedup(spark, sf).collect()}
    assert got == brute(texts)


def family(rng, base, n, edits):
    """Copies of a text with words replaced, some of them too far from all others."""
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(len(w), rng.integers(0, edits), replace=False):
            w[at] = f"edit{i}x{at}"
        out.append(" ".join(w))
    return out


def test_large_group_of_near_copies_loses_no_link(spark):
    rng = np.random.default_rng(5)
    passage = [f"common{i}" for i in range(60)]
    base = [f"word{i}" for i in range(150)]
    rows = family(rng, base, 120, 12)
    rows += [" ".join(passage + [f"own{i}x{j}" for j in range(60)]) for i in range(120)]
    rows += [rows[0]] * 30
    data = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect()}
    assert got == brute(data)


@pytest.mark.parametrize("pivots", [2, 64])
def test_parts_of_one_text(spark, monkeypatch, pivots):
    """Pieces of a long text share all they have with it, so only the hub's shingles link them; some have ends of their own."""
    monkeypatch.setattr(N, "PIVOTS", pivots)
    monkeypatch.setattr(N, "CHUNK", 16)
    rng = np.random.default_rng(11)
    base = [f"word{i}" for i in range(400)]
    rows = [" ".join(base)]
    for i in range(150):
        at, n = rng.integers(0, 300), rng.integers(60, 300)
        rows.append(" ".join(base[at : at + n] + [f"end{i}x{j}" for j in range(rng.integers(0, 20))]))
    data = [(i, t) for i, t in enumerate(rows)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute(data)


def test_thousands_of_near_copies(spark):
    """One group of 3,000 near copies, beside 1,000 texts that share a passage of theirs; against brute force."""
    rng = np.random.default_rng(17)
    base = [f"word{i}" for i in range(80)]
    rows = family(rng, base, 3000, 6)
    rows += [" ".join(base[:50] + [f"own{i}x{j}" for j in range(30)]) for i in range(1000)]
    data = [(i, t) for i, t in enumerate(rows)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute(data)


def test_minima_are_those_of_the_functions():
    found = shingles(" ".join(f"a{i}" for i in range(3000)))
    slow = [min(((int(a) * (int(x) >> 32) + int(b)) % (1 << 64)) >> 32 for x in found) for a, b in zip(N._A[:5], N._B[:5], strict=True)]
    assert N.minima(found)[:5].tolist() == slow


def test_awkward_rows(edge):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in N.near_duplicates(edge).collect()}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True)
    assert got[4, 1] == (4, True) and got[5, 1] == (4, False) and got[7, 1] == (4, False)
    assert got[6, 29_996] == (6, True)
    assert N.near_duplicates(edge).count() == edge.count()


def test_no_rows(nothing):
    assert N.near_duplicates(nothing).count() == 0


def test_chains_and_stars_join(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    got = dict(map(tuple, N.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[202] == 200


def test_stage_keeps_one_of_each_group(spark, edge, sf):
    kept = N.stage(spark, edge, sf)
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 8, 9] and ids.count(None) == 1
    assert kept.columns == edge.columns and kept.dtypes == edge.dtypes


def test_stage_judges_rows_not_ids(spark):
    """Different texts under one id all stay, copies under one id or none leave one row."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, 1, 2), (1, b, 1, 2), (2, c, 1, 2), (2, c, 1, 2), (None, c, 1, 2), (None, a + " more", 1, 2), (None, "x y", 1, 2), (None, "x y", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id int, text string, row int, rest int")
    kept = N.stage(spark, df, "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (2, c), (0, "x y")])
    assert kept.dtypes == df.dtypes
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in N.near_duplicates(df).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 1, False), (0, 2, False), (1, 1, True), (1, 1, True), (2, 2, True), (2, 2, True)]


@pytest.mark.parametrize("text, n", [("a b c d e", 1), ("a b", 1), ("", 0), (None, 0), ("a b c d e f", 2), ("a a a a a a", 1)])
def test_shingle_counts(text, n):
    assert len(shingles(text)) == n


def test_only_ascii_letters_are_lowered():
    assert words("ÄB c d") == ["Äb".encode(), "c d".encode()]
