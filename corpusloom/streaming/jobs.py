"""Structured Streaming twins of batch operators. Each runs to the end of its input with availableNow and equals its batch form."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.sources.workspace import work_dir


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet path as a stream, with the schema of what is there now."""
    # written as a pattern, the path may be a single file as well as a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def arrive(df: DataFrame, part: Column, parts: int, folder: str | None = None) -> DataFrame:
    """df as a stream that brings the rows whose `part` is 0, then 1 and so on, a micro-batch each, from files of a folder.

    Tasks write what they read, so a part is a file of each, and a micro-batch takes as many. Where a task had no row of a part, a
    file with a row that is passed over makes up the number.
    """
    spark = df.sparkSession
    folder = folder or work_dir(spark, "arrive")
    files = max(1, min(df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    told = df.withColumn("__row", F.lit(True))
    for p in range(parts):
        path = f"{folder}/{uuid.uuid4().hex}"
        told.where(part == p).coalesce(files).write.parquet(path)
        lacking = files - len(spark.read.parquet(path).inputFiles())
        if lacking:
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
            spark.range(0, lacking, 1, lacking).select(*none, F.lit(False).alias("__row")).write.mode("append").parquet(path)
    return spark.readStream.schema(told.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*").where("__row").drop("__row")


@contextmanager
def _state_store(spark: SparkSession):
    """Processors with state need the RocksDB store; the session's own setting returns afterwards."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all that is available; its rows, or in complete mode the last table.

    With a folder of its own, a later run goes on where this one ended, with the state it had.
    """
    spark = stream.sparkSession
    folder = folder or work_dir(spark, "stream")
    schema = stream.schema

    def keep(batch: DataFrame, n: int) -> None:
        at = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={n}"
        batch.write.mode("overwrite").parquet(at)

    with _state_store(spark):
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def daily_counts(events: DataFrame, where: Column, late: str = "1 day") -> DataFrame:
    """(day, n) in windows of a day; events later than `late` are dropped. events: ts timestamp."""
    days = events.where(where).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    return days.agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def pairs(asked: DataFrame, answered: DataFrame, bound: str = "12 hours") -> DataFrame:
    """Questions with each answer of the same user within the bound, or null when the watermark has passed it."""
    q = asked.withWatermark("ts", "1 hour").alias("q")
    a = answered.withWatermark("ts", "1 hour").alias("a")
    on = F.expr(f"q.user_id = a.user_id AND a.ts > q.ts AND a.ts <= q.ts + interval {bound}")
    return q.join(a, on, "left_outer").select(F.col("q.event_id").alias("event_id"), F.col("a.event_id").alias("answer_id"), F.col("a.ts").alias("answer_ts"))


class _Memory(StatefulProcessor):
    """A conversation's last n messages, and what falls out of them."""

    def __init__(self, n: int, cut: int) -> None:
        self.n, self.cut = n, cut

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "turn long, role string, text string")
        self.asked = handle.getValueState("asked", "text string")

    def handleInputRows(self, key, rows, timerValues):
        held = {r[0]: tuple(r) for r in self.held.get()}
        oldest = min(held, default=None)
        for r in rows:
            if oldest is None or r["turn"] > oldest or len(held) < self.n:
                held.setdefault(r["turn"], (r["turn"], r["role"], r["text"]))
        order = sorted(held.values())
        asked = self.asked.get()[0] if self.asked.exists() else None
        for turn, role, text in order[: -self.n]:
            if role == "user":
                asked = text
            elif role == "assistant":
                yield Row(conv_id=key[0], evicted=turn, user_text=asked, answer=text and text[: self.cut], turns=None, context=None)
        order = order[-self.n :]
        self.held.put(order)
        if asked is not None:
            self.asked.update((asked,))
        context = "\n".join(f"{role.capitalize()}: {text}" for _, role, text in order if role and text is not None)
        yield Row(conv_id=key[0], evicted=None, user_text=None, answer=None, turns=",".join(str(t) for t, *_ in order), context=context)

    def close(self) -> None:
        pass


def memory(messages: DataFrame, n: int = 8, cut: int = 200) -> DataFrame:
    """(conv_id, evicted, user_text, answer, turns, context) of messages (conv_id, turn, role, text) that come in order.

    After each batch that brings some, a row with the turns and the text of a conversation's last n messages; and one for each
    assistant message that falls out of them, with the user's words before it and its first `cut` characters, to be
    summed up. A turn that comes twice counts once; state is a list of n messages and one text a conversation.
    """
    out = "conv_id long, evicted long, user_text string, answer string, turns string, context string"
    rows = messages.select("conv_id", F.col("turn").cast("long"), "role", "text")
    return rows.groupBy("conv_id").transformWithState(_Memory(n, cut), out, "update", "None")


class _InOrder(StatefulProcessor):
    """Rows (k, id, t, ts) of a key wait in state until the watermark has passed them; then step() sees them by time and id.

    So the outcome doesn't depend on how rows were split and shuffled, if they aren't later than the watermark. One timer a key
    wakes it for the next row that waits, or for the end of what is known.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, id long")

    def handleInputRows(self, key, rows, timerValues):
        new = [(r["t"], r["id"]) for r in rows if r["id"] is not None]
        if new:
            self.waiting.appendList(new)
        return self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._release(key, timerValues)

    def _release(self, key, timerValues):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get())
        ready = [x for x in held if x[0] <= now]
        if ready:
            yield from self.step(key[0], ready)
            self.waiting.put(held[len(ready) :]) if len(ready) < len(held) else self.waiting.clear()
        ends = self.ends(now)
        wake = min([x for x in (held[len(ready)][0] if len(ready) < len(held) else None, ends) if x is not None], default=None)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wake is not None:
            self.handle.registerTimer(-(-wake // 1000))

    def close(self) -> None:
        pass


class _Limit(_InOrder):
    def __init__(self, most: int, window_s: float) -> None:
        self.most, self.window = most, int(window_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.log = handle.getListState("log", "t long")

    def step(self, key, ready):
        log = deque(r[0] for r in self.log.get())
        for t, event in ready:
            ok, left, first = _admit(log, t, self.most, self.window)
            yield Row(event_id=event, admitted=ok, remaining=left, reset_s=(first + self.window - t) / 1e6)
        self.log.put([(t,) for t in log])

    def ends(self, now):
        last = max((r[0] for r in self.log.get()), default=None)
        if last is not None and last + self.window <= now:
            self.log.clear()
            return None
        return None if last is None else last + self.window


class _Cache(_InOrder):
    def __init__(self, ttl_s: float) -> None:
        self.ttl = int(ttl_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entry = handle.getValueState("entry", "id long, t long")

    def step(self, key, ready):
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        for t, event in ready:
            hit = entry is not None and entry[1] + self.ttl > t
            if not hit:
                entry = (event, t)
            yield Row(query_hash=key, event_id=event, entry_id=entry[0], hit=hit)
        self.entry.update(entry)

    def ends(self, now):
        if not self.entry.exists():
            return None
        until = self.entry.get()[1] + self.ttl
        if until <= now:
            self.entry.clear()
            return None
        return until


def _keyed(events: DataFrame, key: str, late: str) -> DataFrame:
    rows = events.select(F.col(key).alias("k"), F.col("event_id").alias("id"), F.unix_micros("ts").alias("t"), "ts")
    return rows.withWatermark("ts", late).groupBy("k")


def cache_answers(events: DataFrame, key: str, ttl_s: float = 7 * 86400.0, late: str = "1 day") -> DataFrame:
    """(query_hash, event_id, entry_id, hit): each question answered by the live entry of its hash, or admitted as the next one.

    events: key, event_id, ts timestamp. An entry lives ttl_s seconds of event time from its admission; a question at its end or
    later is a miss, and is admitted. Processing-time TTL would give other answers when a stream is replayed, so
    entries end by event-time timers. Rows without event_id only move the watermark.
    """
    return _keyed(events, key, late).transformWithState(_Cache(ttl_s), "query_hash string, event_id long, entry_id long, hit boolean", "append", "EventTime")


def rate_limit_stream(events: DataFrame, key: str, most: int, window_s: float, late: str = "1 day") -> DataFrame:
    """rate_limit_audit() of a stream: rows (event_id, admitted, remaining, reset_s) come out once the watermark has passed them."""
    return _keyed(events, key, late).transformWithState(_Limit(most, window_s), "event_id long, admitted boolean, remaining int, reset_s double", "append", "EventTime")


def sync(documents: DataFrame, apply: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    """Hand each batch of new documents to `apply` with its number; a replayed number must change nothing."""
    folder = folder or work_dir(documents.sparkSession, "sync")
    documents.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()


def _admit(log: deque, t: int, most: int, window: int) -> tuple[bool, int, int]:
    """Whether an event at t is admitted, how many more would be, and the oldest stamp that counts; the log keeps admitted ones only."""
    while log and log[0] <= t - window:
        log.popleft()
    ok = len(log) < most
    if ok:
        log.append(t)
    return ok, most - len(log), log[0] if log else t


def rate_limit_audit(events: DataFrame, key: str, most: int, window_s: float) -> DataFrame:
    """(event_id, admitted, remaining, reset_s): a sliding log per key in which only admitted events are kept.

    Rows come sorted by key and time and pass through once; a task holds the stamps of one key, `most` of them.
    """
    stamped = events.select("event_id", F.col(key).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    window = int(window_s * 1e6)

    def run(batches):
        key, log = object(), deque()
        for batch in batches:
            out = []
            for event, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, log = k, deque()
                ok, left, first = _admit(log, t, most, window)
                out.append((event, ok, left, (first + window - t) / 1e6))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.int32(), pa.float64()), strict=True)], ["event_id", "admitted", "remaining", "reset_s"])

    return stamped.repartition("k").sortWithinPartitions("k", "t", "event_id").mapInArrow(run, "event_id long, admitted boolean, remaining int, reset_s double")
