"""Streams over several micro-batches, restarts and replays; snapshots and published tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import publish, snapshots, workspace
from corpusloom.streaming import jobs


@pytest.fixture
def folder(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def test_memory_goes_on_where_a_run_ended(spark, folder):
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c} says {t} " + "x" * 300) for c in range(3) for t in range(2 + 7 * c)]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    out = None
    for first in (0, 4, 9):
        part = F.when(F.col("turn").between(first, {0: 3, 4: 8, 9: 99}[first]), 0).otherwise(-1)
        out = jobs.drain(jobs.memory(jobs.arrive(df, part, 1, folder("inbox")), 4, 20), "update", folder("run"))
    evicted = sorted((r["conv_id"], r["evicted"], r["user_text"], r["answer"]) for r in out.where("evicted IS NOT NULL").collect())
    want = []
    for c in range(3):
        mine = [x for x in talk if x[0] == c]
        want += [(c, t, mine[t - 1][3], text[:20]) for _, t, role, text in mine[: max(0, len(mine) - 4)] if role == "assistant"]
    assert evicted == sorted(want) and len(want) == 8
    last = out.where("turns IS NOT NULL").groupBy("conv_id").agg(F.max_by("turns", "batch").alias("turns")).collect()
    assert {r["conv_id"]: r["turns"] for r in last} == {0: "0,1", 1: "5,6,7,8", 2: "12,13,14,15"}


def test_a_turn_that_comes_twice_counts_once(spark, folder):
    df = spark.createDataFrame([(1, t, "user", f"t{t}") for t in (0, 1, 2, 2, 1, 3)], "conv_id long, turn long, role string, text string")
    out = jobs.drain(jobs.memory(jobs.arrive(df, F.when(F.col("turn") == 1, 1).otherwise(0), 2), 3), "update")
    assert {r["turns"] for r in out.where("turns IS NOT NULL").collect()} == {"0,2,3", "1,2,3"} or out.where("turns = '1,2,3'").count() == 1


DAY = 86_400


def arriving(spark, rows, parts, seed):
    """Rows in order of time, up to 20 hours late, dealt to micro-batches; the last row moves the watermark past all."""
    rng = random.Random(seed)
    late = sorted((t + rng.random() * 20 * 3600, e, k, t) for e, k, t in rows)
    span = late[-1][0] - late[0][0] + 1
    data = [(e, k, t, int((x - late[0][0]) / span * parts)) for x, e, k, t in late] + [(None, None, 4_000_000_000, parts)]
    df = spark.createDataFrame(data, "event_id long, k string, s long, part int").withColumn("ts", F.timestamp_seconds("s"))
    return jobs.arrive(df.drop("s"), F.col("part"), parts + 1)


def test_cache_entries_end_after_their_time(spark):
    times = {"a": [0, 1, 6.9, 7, 7.5, 13.9, 14, 30], "b": [3, 20, 26.99, 27], "c": [5]}
    rows = [(100 * i + j, k, int(1_700_000_000 + t * DAY)) for i, (k, ts) in enumerate(times.items()) for j, t in enumerate(ts)]
    want = {}
    for k in times:
        entry = None
        for e, _, t in sorted((r for r in rows if r[1] == k), key=lambda r: r[2]):
            hit = entry is not None and t < entry[1] + 7 * DAY
            entry = entry if hit else (e, t)
            want[e] = (entry[0], hit)
    for parts, seed in ((1, 1), (5, 2)):
        got = jobs.drain(jobs.cache_answers(arriving(spark, rows, parts, seed), "k")).collect()
        assert {r["event_id"]: (r["entry_id"], r["hit"]) for r in got} == want and len(got) == len(rows)
    assert [want[e][1] for e in (0, 1, 2, 3, 4, 5, 6)] == [False, True, True, False, True, True, False]


def test_rate_limits_of_a_stream_are_those_of_the_table(spark):
    rng = random.Random(4)
    rows = [(i, f"u{rng.randrange(4)}", 1_700_000_000 + rng.randrange(6 * DAY)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = sorted(map(tuple, jobs.rate_limit_audit(df, "k", 3, float(DAY)).collect()))
    got = sorted(map(tuple, jobs.drain(jobs.rate_limit_stream(arriving(spark, rows, 4, 5), "k", 3, float(DAY))).drop("batch").collect()))
    assert got == want and len({r[1] for r in want}) == 2


def chunks(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("no", "text"))


def table(spark, path):
    return snapshots.Snapshots(spark, path, "doc_id long, no int, text string", 8)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, text string")


def held(t, name):
    return sorted(map(tuple, t.read(name).collect()))


def test_snapshots_classify_write_what_changes_and_ignore_replays(spark, folder, tmp_path):
    path = folder("snap")
    t = table(spark, path)
    assert held(t, "chunks") == []
    assert t.apply(docs(spark, [(i, f"t{i}", f"a{i} b{i}") for i in range(40)]), 0, chunks)
    first = held(t, "chunks")
    assert len(first) == 80
    batch = docs(spark, [(1, "t1", "new text here"), (2, "renamed", "a2 b2"), (3, "t3", "a3 b3"), (4, "t4", None), (99, "t99", "z"), (99, "t99", "a")])
    assert table(spark, path).apply(batch, 1, chunks)
    after = held(t, "chunks")
    assert after == sorted([x for x in first if x[0] != 1] + [(1, 0, "new"), (1, 1, "text"), (1, 2, "here"), (99, 0, "z")])
    titles = {r[0]: r[1] for r in held(t, "documents")}
    assert titles[2] == "renamed" and titles[99] == "t99" and len(titles) == 41
    told = {r["batch"]: r["changes"] for r in t.log().collect()}
    assert told[1] == '{"created":1,"failed":1,"retitled":1,"skipped":1,"updated":1}'
    buckets = {r[0] for r in docs(spark, [(i, "", "") for i in (1, 2, 99)]).select(F.pmod(F.xxhash64("doc_id"), F.lit(8))).collect()}
    written = {int(p.name.split("=")[1]) for p in (tmp_path / "snap/chunks/version=1").glob("bucket=*")}
    assert written == buckets
    again = table(spark, path)
    assert not again.apply(batch, 1, chunks) and not again.apply(docs(spark, [(5, "x", "y")]), 0, chunks) and held(again, "chunks") == after


def test_a_batch_that_failed_is_not_seen_and_is_done_again(spark, folder):
    path = folder("snap")
    t = table(spark, path)
    t.apply(docs(spark, [(i, "t", f"w{i}") for i in range(10)]), 0, chunks)
    before = held(t, "chunks")
    batch = docs(spark, [(i, "t", f"changed{i}") for i in range(5)])

    def broken(df):
        return chunks(df).withColumn("text", F.when(F.col("doc_id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))

    with pytest.raises(Exception, match="lost"):
        t.apply(batch, 1, broken)
    assert held(table(spark, path), "chunks") == before
    assert t.apply(batch, 1, chunks) and {x[2] for x in held(t, "chunks")} == {f"changed{i}" for i in range(5)} | {f"w{i}" for i in range(5, 10)}


def test_streamed_snapshots_end_like_one_batch(spark, folder):
    rows = [(i % 30, f"t{i}", f"text {i}") for i in range(60)]
    df = docs(spark, rows)
    t = table(spark, folder("snap"))
    jobs.sync(jobs.arrive(df.withColumn("part", F.floor(F.substring("title", 2, 9).cast("int") / 30)), F.col("part"), 2, folder("in")), lambda b, n: t.apply(b.drop("part"), n, chunks), folder("state"))
    whole = table(spark, folder("whole"))
    whole.apply(docs(spark, rows[30:]), 0, chunks)
    assert held(t, "chunks") == held(whole, "chunks") and t.log().select("batch").distinct().count() == 2


def test_no_task_writes_or_reads_a_part_alone(spark, folder):
    rows = spark.range(0, 900, 1, 3).select("id", (F.col("id") % 2).alias("part")).unionByName(spark.range(1).select(F.lit(-1).alias("id"), F.lit(2).alias("part")))
    at, got = folder("in"), []
    stream = jobs.arrive(rows, F.col("part"), 3, at)
    assert spark.read.parquet(f"{at}/*").where("__row AND part = 0").select(F.input_file_name()).distinct().count() > 1
    jobs.sync(stream, lambda b, n: got.append((n, sorted(r["id"] for r in b.collect()))), folder("state"))
    assert got == [(0, list(range(0, 900, 2))), (1, list(range(1, 900, 2))), (2, [-1])]


def test_a_large_bucket_is_written_by_several_tasks(spark, folder):
    path = folder("snap")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        t = snapshots.Snapshots(spark, path, "doc_id long, line_no long, text string", 1)
        t._write("chunks", spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("line_no"), F.sha2(F.col("id").cast("string"), 512).alias("text")), 0)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(spark.read.parquet(f"{path}/chunks").inputFiles()) > 1 and spark.read.parquet(f"{path}/chunks").count() == 20_000


def test_published_tables_come_in_order_and_whole(spark, folder):
    a, b, c = (spark.createDataFrame([(i, f"{n}{i}") for i in range(20)], "id long, x string") for n in "abc")
    p = publish.Publisher(spark, folder("pub"))
    assert p.read() == {}
    p.publish({"a": a, "b": b, "c": c}, {"a": ["b"], "b": ["c"]}, "one")
    assert p.order == ["c", "b", "a"] and sorted(p.read()["a"].collect()) == sorted(a.collect())

    def short(name, df, path):
        (df.where("id <> 3") if name == "b" else df).write.mode("overwrite").parquet(path)

    def changed(name, df, path):
        (df.withColumn("x", F.when(F.col("id") == 3, "?").otherwise(F.col("x"))) if name == "b" else df).write.mode("overwrite").parquet(path)

    for copy, told in ((short, "20 rows in the source, 19"), (changed, "other values")):
        with pytest.raises(publish.PublishError, match=told):
            p.publish({"b": b, "c": c}, {"b": ["c"]}, "two", copy)
        assert p.current()[1] == "one"
    p.publish({"b": b.limit(5), "c": c}, {"b": ["c"]}, "two")
    assert p.current()[:2] == (1, "two") and p.read()["b"].count() == 5
    with pytest.raises(Exception, match="cycle"):
        p.publish({"a": a, "b": b}, {"a": ["b"], "b": ["a"]})
    with pytest.raises(publish.PublishError, match="not published: z"):
        p.publish({"a": a}, {"a": ["z"]})


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = type("c", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("x", (), {"master": "yarn", "applicationId": "a"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session)
