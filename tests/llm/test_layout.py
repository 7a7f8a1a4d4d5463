"""Shards, packing and training order: laws and exact round trips."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import packing, sharding, tokens, training_order


def draw(key, level, at, weight):
    h = xxhash.xxh64_intdigest(level.encode(), seed=42)
    h = xxhash.xxh64_intdigest(at.to_bytes(4, "little"), seed=h)
    h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=h)
    return -math.log((h % (1 << 52) + 0.5) / (1 << 52)) / weight


def descend(key, shards, weights):
    """The same tree in plain Python: the least draw on each level."""
    weight = lambda node: sum(weights.get(s, 1.0) for s in node)
    regions = sharding.tree(shards)
    flat = lambda region: [s for rack in region for s in rack]
    region = min(range(len(regions)), key=lambda r: draw(key, "region", r, weight(flat(regions[r]))) if len(regions) > 1 else 0)
    rack = min(regions[region], key=lambda k: draw(key, "rack", k[0] // 4, weight(k)))
    return min(rack, key=lambda s: draw(key, "shard", s, weight([s])))


@pytest.mark.parametrize("shards, weights", [(16, {}), (17, {}), (21, {3: 2.5, 20: 0.5}), (4, {}), (1, {})])
def test_descent_takes_the_least_draw_on_each_level(spark, shards, weights):
    rows = {r["doc_id"]: r["shard"] for r in sharding.assign(spark.range(300).withColumnRenamed("id", "doc_id"), shards, weights=weights).collect()}
    assert rows == {d: descend(d, shards, weights) for d in range(300)}


def test_shards_of_whole_table(spark, sf, texts):
    rows = sharding.op4_sharding(spark, sf).collect()
    size = {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t, _ in texts}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == size
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)


@pytest.mark.parametrize("shards", [8, 16, 24])
def test_a_new_region_only_takes_rows(spark, shards):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    both = sharding.assign(sharding.assign(df, shards, to="a"), shards + 1, to="b")
    assert both.where((F.col("a") != F.col("b")) & (F.col("b") != shards)).count() == 0
    assert both.where(F.col("b") == shards).count() > 0


@pytest.mark.parametrize("weights, shards", [({5: 3.0}, 16), ({5: 0.25}, 16), ({5: 0.0}, 16), ({}, 11)])
def test_movement_stays_in_the_changed_subtree(spark, weights, shards):
    """Shard 5 lies in rack 1 of region 0. Only rows that enter or leave the region, its rack 1, or shard 5 there change place."""
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    rows = sharding.assign(sharding.assign(df, shards, to="a"), shards + (not weights), weights=weights, to="b").collect()
    changed = 5 if weights else shards
    moved = 0
    for r in rows:
        (ra, ka), (rb, kb), (rc, kc) = ((s // 8, s // 4) for s in (r["a"], r["b"], changed))
        moved += r["a"] != r["b"]
        if ra != rb:
            assert rc in (ra, rb)
        elif ka != kb:
            assert ra == rc and kc in (ka, kb)
        elif r["a"] != r["b"]:
            assert ka == kc and changed in (r["a"], r["b"])
    assert 0 < moved < len(rows) / 2
    share = sum(r["b"] == 5 for r in rows) / len(rows)
    if weights:
        assert abs(share - weights[5] / (15 + weights[5])) < 0.03


def test_slots_of_a_key_that_all_rows_repeat(spark):
    df = spark.range(3000).select(F.lit(7).alias("doc_id"), (F.col("id") % 2).alias("size"))
    slots = sorted(r["slot"] for r in sharding.number(sharding.assign(df), unit_rows=100).collect())
    assert slots == list(range(3000))


def test_sharding_awkward_rows(edge, nothing):
    out = sharding.assign(edge)
    assert out.count() == edge.count() and out.where("shard is null").count() == 0
    assert sharding.assign(nothing).count() == 0


def test_sharding_keeps_columns_of_its_own_names(spark):
    df = spark.range(40).withColumnRenamed("id", "doc_id")
    clash = {c: F.concat(F.lit(c), "doc_id") for c in ("__row", "__unit", "__n", "__from", "__rank", "__region", "__rack")}
    rows = sharding.number(sharding.assign(df.withColumns(clash)), 10).collect()
    assert len(rows) == 40 and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in clash)
    plain = {r["doc_id"]: r["shard"] for r in sharding.assign(df).collect()}
    assert {r["doc_id"]: r["shard"] for r in rows} == plain


def test_packing_and_order_of_clashing_names(spark):
    df = spark.createDataFrame([(i, "text " * i) for i in range(20)], "doc_id long, text string")
    clash = df.withColumns({c: F.lit("x") for c in ("slot", "place", "task", "local", "length", "n", "row", "seq", "ids")})
    assert sorted(map(tuple, packing.pack(clash).select("doc_id", "piece", "length").collect())) == sorted(map(tuple, packing.pack(df).select("doc_id", "piece", "length").collect()))
    assert training_order.training_order(clash).select("doc_id", "n_tokens").exceptAll(training_order.training_order(df).select("doc_id", "n_tokens")).count() == 0


LETTERS = st.text(alphabet=st.characters(max_codepoint=0x24F, exclude_categories=("Cs",)), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.one_of(LETTERS, st.text(max_size=40), st.sampled_from(["a<|endoftext|>b", "  \n\n x", "'ll don't", "\x1c\x1d \x85\xa0x"])))
def test_ids_are_those_of_tokenizers(text):
    path = tokens.default_path()
    assert tokens.encode(text, path) == tokens._reference(path).encode(text, add_special_tokens=False).ids


def check_packing(rows, texts):
    path, seen = tokens.default_path(), {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
    for d, t, *_ in texts:
        ids, at = [*tokens.encode(t, path), 2], 0
        for r in sorted(seen[d], key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
        assert all(r["length"] == 1024 for r in seen[d] if r["piece"] > 0)
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values(), default=0) <= 1024
    return len(ends), sum(ends.values())


def test_packing_of_whole_table(spark, sf, texts):
    bins, total = check_packing(packing.op9_packing(spark, sf).collect(), texts)
    assert bins <= 1.03 * -(-total // 1024)


def test_sum_of_squares_wastes_little():
    """A tile of many lengths: 0.3 % over the bound at most."""
    lengths = np.minimum(1023, np.random.default_rng(2).lognormal(5, 1.2, 40_000).astype(int) + 1)
    rows, made = packing.pack_tile(dict(Counter(lengths.tolist())))
    assert made <= 1.003 * -(-int(lengths.sum()) // 1024) and len(rows) == len(lengths)


def test_each_piece_goes_where_the_squares_become_least():
    """Against the rule, worked out in full for each choice."""
    counts = {int(x): 3 for x in np.random.default_rng(4).integers(1, 60, 40)}
    rows, made = packing.pack_tile(counts, 64)
    gaps = Counter()
    filled = Counter()
    for length, _, seq, offset in rows.tolist():
        assert filled[seq] == offset
        choices = [g for g in gaps if gaps[g] and g >= length] + [64]
        def squares(g):
            after = gaps.copy()
            if g < 64:
                after[g] -= 1
            if g > length:
                after[g - length] += 1
            return sum(n * n for n in after.values())
        taken = 64 - offset
        assert squares(taken) == min(map(squares, choices))
        if taken < 64:
            gaps[taken] -= 1
        if taken > length:
            gaps[taken - length] += 1
        filled[seq] += length
    assert len(filled) == made


def test_packing_awkward_rows(edge, nothing):
    rows = packing.pack(edge).collect()
    assert Counter(r["doc_id"] for r in rows)[7] == 2 and sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2
    assert packing.pack(nothing).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 1023), st.integers(0, 400), max_size=12), st.sampled_from([50, 1000, 65_536]))
def test_plan_places_every_piece_once(counts, tile):
    levels, slots, sequences = packing.plan(counts, tile)
    used, ends, seen = Counter(), Counter(), Counter()
    for length, level, first, each, times, base, made in levels:
        assert first == used[length]
        used[length] += each * times
        mine = slots[level][slots[level][:, 0] == length]
        assert sorted(mine[:, 1]) == list(range(each))
        for t in range(times):
            for _, _, seq, offset in mine.tolist():
                s = base + t * made + seq
                assert 0 <= s < sequences and offset + length <= 1024
                ends[s] += length
                seen[s, offset] += 1
    assert used == Counter({k: n for k, n in counts.items() if n}) and max(seen.values(), default=1) == 1 and max(ends.values(), default=0) <= 1024


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**40))
def test_permutation(n, key):
    assert sorted(training_order.permute(np.arange(n), n, key)) == list(range(n))


def test_training_order_round_trip(spark, sf, texts, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ordered = training_order.training_order(docs, per_shard=64)
    rows = ordered.collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    path, whole = tokens.default_path(), {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        whole.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes(r["ids"]), "<u2").tolist())
    assert whole == {d: [*tokens.encode(t, path), 2] for d, t, _ in texts}
    training_order.write_shards(ordered, str(tmp_path / "shards"), block=32)
    for a, b in ((0, 5), (60, 70), (100, 10**6)):
        got = training_order.read_slots(spark, str(tmp_path / "shards"), a, b).collect()
        assert [(r["slot"], r["doc_id"], bytes(r["ids"])) for r in got] == [(r["slot"], r["doc_id"], bytes(r["ids"])) for r in rows[a:b]]


@pytest.mark.parametrize("width", [2, 4])
def test_wide_ids_manifest_and_damage(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(tokens, "width", lambda _: width)
    docs = spark.createDataFrame([(i, f"text {i} " * 400) for i in range(30)], "doc_id long, text string")
    ordered = training_order.training_order(docs, per_shard=8)
    path = str(tmp_path / "shards")
    training_order.write_shards(ordered, path, block=3, width=width)
    want = [(r["slot"], r["doc_id"], bytes(r["ids"])) for r in ordered.collect()]
    assert [(r["slot"], r["doc_id"], bytes(r["ids"])) for r in training_order.read_slots(spark, path, 0, 10**6).collect()] == want
    told = {r["shard"]: (r["first_slot"], r["records"]) for r in training_order.manifest(spark, path).collect()}
    assert told == {s: (8 * s, min(8, len(want) - 8 * s)) for s in range(-(-len(want) // 8))}
    blocks = spark.read.parquet(path)
    assert all(len(b["payload"]) == b["n"] * training_order.record(width).itemsize for b in blocks.collect())
    with pytest.raises(Exception, match="damaged"):
        training_order.read_shards(blocks.withColumn("crc32", F.col("crc32") + 1)).collect()


def test_training_order_awkward_rows(edge, nothing):
    assert training_order.training_order(edge).where("n_tokens = 1").count() == 2
    assert training_order.training_order(nothing).count() == 0


def test_records_keep_null_and_negative_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "no id"), (-1, "minus one"), (5, None), (6, "word " * 3000)], "doc_id long, text string")
    ordered = training_order.training_order(docs, per_shard=2)
    want = [(r["slot"], r["doc_id"], r["seq"], r["n_tokens"], bytes(r["ids"])) for r in ordered.collect()]
    training_order.write_shards(ordered, str(tmp_path / "shards"), block=3)
    got = [(r["slot"], r["doc_id"], r["seq"], r["n_tokens"], bytes(r["ids"])) for r in training_order.read_slots(spark, str(tmp_path / "shards"), 0, 10**6).collect()]
    assert got == want and {d for _, d, *_ in got} == {None, -1, 5, 6}


def test_training_order_query_writes_what_it_reports(spark, sf, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(training_order, "shared_dir", lambda _: f"file://{tmp_path}", raising=False)
    rows = training_order.op5_training_order(spark, sf).collect()
    (written,) = tmp_path.glob("training-order-*")
    held = training_order.read_slots(spark, str(written), 0, len(rows)).collect()
    assert [(r["slot"], r["doc_id"], r["seq"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [(r["slot"], r["doc_id"], r["seq"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in held]
    assert [(r["slot"], r["shard"], r["record"]) for r in rows] == [(i, *divmod(i, training_order.PER_SHARD)) for i in range(len(rows))]
    for b in spark.read.parquet(str(written)).collect():
        assert len(b["payload"]) == b["n"] * training_order.STRIDE
    path = tokens.default_path()
    assert sum(r["n_tokens"] for r in rows) == sum(len(tokens.encode(t, path)) + 1 for _, t, _ in texts)
