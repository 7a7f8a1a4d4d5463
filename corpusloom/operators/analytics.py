"""Conversation and usage analytics: as-of pairing, anti joins, roll-ups, trends, pages, set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def next_answer(messages: DataFrame, key: str, ts: str, id_: str, is_answer: Column, carry: Mapping[str, Column], strict: bool = True) -> DataFrame:
    """Each row with `carry` of the earliest later answer under its key, as struct column `answer` (null if none).

    One window over the key, no self join: latest rows come first, so the frame only grows and a key costs what its rows do.
    Strict pairing takes only answers with a later time; else equal times count too. Ties go to the smaller id.
    """
    packed = F.when(is_answer, F.struct(F.col(ts).alias("ts"), F.col(id_).alias("id"), *[c.alias(n) for n, c in carry.items()]))
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp")).desc())
    frame = w.rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    return messages.withColumn("answer", F.min(packed).over(frame))


def previous(messages: DataFrame, key: str, order: Sequence[str], where: Column, value: Column, name: str) -> DataFrame:
    """The last value before each row, in order, of the rows that meet `where`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn(name, F.last(F.when(where, value), ignorenulls=True).over(w))


def unanswered(messages: DataFrame, key: str, ts: str, is_question: Column, is_answer: Column) -> DataFrame:
    """Questions with no later answer under their key: a comparison with the key's last answer, not a theta join."""
    last = messages.groupBy(key).agg(F.max(F.when(is_answer, F.col(ts))).alias("__last"))
    return messages.where(is_question).join(last, key).where(F.col("__last").isNull() | (F.col("__last") <= F.col(ts))).drop("__last")


def keyset_page(df: DataFrame, order: Sequence[tuple[str, bool]], size: int, cursor: Sequence | None = None) -> DataFrame:
    """The next `size` rows strictly after the cursor in an order of (column, descending); with size + 1 rows there are more."""
    if cursor is not None:
        after, equal = F.lit(False), F.lit(True)
        for (c, down), v in zip(order, cursor, strict=True):
            after = after | (equal & ((F.col(c) < v) if down else (F.col(c) > v)))
            equal = equal & (F.col(c) == v)
        df = df.where(after)
    return df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(size)


def within(ts: Column, as_of: str, days: int | None) -> Column:
    return F.lit(True) if days is None else ts >= F.expr(f"{as_of} - interval {days} days")


def message_stats(messages: DataFrame, is_answer: Column, is_cached: Column, latency: Column) -> DataFrame:
    return messages.agg(F.count_if(is_answer).alias("answers"), F.count_if(is_answer & is_cached).alias("cached"), F.avg(latency).alias("avg_latency"))


def daily_counts(messages: DataFrame, ts: str, where: Column) -> DataFrame:
    return messages.where(where).groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def share_by(df: DataFrame, c: Column, name: str) -> DataFrame:
    """Rows per value and their share of all; nulls are left out."""
    n = df.where(c.isNotNull()).groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("__total"))  # one row
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def day_over_day(daily: DataFrame) -> DataFrame:
    """Percent change against the day before, null without one or after zero, and the series' average. One row a day."""
    w = Window.orderBy("day")
    before = F.lag("n").over(w)
    change = F.when(before > 0, half_up((F.col("n") - before) * 100 / before))
    return daily.select("day", "n", change.alias("change"), F.avg("n").over(Window.partitionBy()).alias("average"))


def half_period_trend(daily: DataFrame) -> DataFrame:
    """Percent change of the later half of the days against the earlier one; null under four days or after zero."""
    n = daily.select("n", F.row_number().over(Window.orderBy("day")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("days"))
    early = F.sum(F.when(F.col("i") <= F.floor(F.col("days") / 2), F.col("n")).otherwise(0))
    late = F.sum(F.when(F.col("i") > F.floor(F.col("days") / 2), F.col("n")).otherwise(0))
    both = n.agg(F.max("days").alias("days"), early.alias("early"), late.alias("late"))
    return both.select("early", "late", F.when((F.col("days") >= 4) & (F.col("early") > 0), half_up((F.col("late") - F.col("early")) * 100 / F.col("early"))).alias("trend"))


def health_band(rate: Column) -> Column:
    return F.when(rate >= 0.6, "healthy").when(rate >= 0.3, "fair").otherwise("low")


#: USD per million input and output tokens, by model; the default of the same provider.
PRICES = (("llama-3.1-8b-instant", 0.05, 0.08), ("llama-3.3-70b-versatile", 0.59, 0.79), ("llama-3.1-70b-versatile", 0.59, 0.79))
DEFAULT_PRICE = (0.05, 0.08)


def llm_cost(calls: DataFrame, provider: str = "groq") -> DataFrame:
    """Calls (provider, model, prompt_tokens, completion_tokens) with cost_usd; other providers cost nothing."""
    prices = calls.sparkSession.createDataFrame(PRICES, "model string, __in double, __out double")
    priced = calls.join(F.broadcast(prices), "model", "left")
    usd = F.col("prompt_tokens") / 1e6 * F.coalesce("__in", F.lit(DEFAULT_PRICE[0])) + F.col("completion_tokens") / 1e6 * F.coalesce("__out", F.lit(DEFAULT_PRICE[1]))
    return priced.withColumn("cost_usd", F.when(F.col("provider") == provider, usd).otherwise(0.0)).drop("__in", "__out")


def agent_costs(calls: DataFrame) -> DataFrame:
    """Totals per agent, told by the stage's label, in the order research, analyst, writer; others are left out."""
    stage = F.lower("stage")
    agent = F.when(F.contains(stage, F.lit("research")), 1).when(F.contains(stage, F.lit("analyst")), 2).when(F.contains(stage, F.lit("writer")), 3)
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "latency_ms", "cost_usd")]
    totals = calls.where(agent.isNotNull()).groupBy(agent.alias("position")).agg(F.count(F.lit(1)).alias("calls"), *sums)
    return totals.withColumn("agent", F.element_at(F.array(*[F.lit(a) for a in ("research", "analyst", "writer")]), F.col("position"))).orderBy("position")


def last_n(messages: DataFrame, key: str, order: str, n: int = 8) -> DataFrame:
    """Messages with `evicted`: whether they lie before the last n of their key."""
    return messages.withColumn("evicted", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) > n)


def joined_text(df: DataFrame, keys: Sequence[str], order: str, block: Column, by: str = "\n", name: str = "text") -> DataFrame:
    """One text per key from its blocks in order."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(blocks, lambda x: x["b"]), by).alias(name))


def keep_latest(df: DataFrame, order: Sequence[tuple[str, bool]], n: int, always: Column) -> DataFrame:
    """Rows with `kept`: among the n newest, or always to be kept. A limit and a join on its ids, no global window."""
    ids = [c for c, _ in order]
    newest = keyset_page(df.select(*ids), order, n).withColumn("__kept", F.lit(True))
    return df.join(F.broadcast(newest), ids, "left").withColumn("kept", F.coalesce("__kept", F.lit(False)) | always).drop("__kept")


def drop_repeats(messages: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Messages without those that repeat the role and text right before them."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.lag(role).over(w).eqNullSafe(F.col(role)) & F.lag(text).over(w).eqNullSafe(F.col(text))
    return messages.withColumn("__same", same & (F.row_number().over(w) > 1)).where(~F.col("__same")).drop("__same")


def percentiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median (interpolated) and 95th percentile (an observed value)."""
    return df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"))


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, accuracy: int = 1000) -> DataFrame:
    """(keys, sketch, n): a mergeable KLL sketch of the values of each group, a few kilobytes however many rows it has.

    Written by day, say, once; sketched_percentiles() merges them for any window. A rank is off by about 2.3 / accuracy of the rows
    at most, 99 times in 100.
    """
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(accuracy)).alias("sketch"), F.count(value).alias("n")).where("n > 0")


def sketched_percentiles(sketches: DataFrame, keys: Sequence[str], ranks: Mapping[str, float]) -> DataFrame:
    """(keys, n, one column a rank) from sketches merged by the keys; ranks: column name to rank between 0 and 1."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(r)).alias(name) for name, r in ranks.items()])


def rank_errors(df: DataFrame, keys: Sequence[str], value: str, told: DataFrame, ranks: Mapping[str, float]) -> DataFrame:
    """(keys, one column a rank): how far the told quantile's true rank lies from the one asked for, as a share of the group's rows.

    A value that many rows share covers all ranks from the first to the last of them.
    """
    met = df.join(F.broadcast(told.select(*keys, *ranks)), list(keys))
    share = lambda c: F.avg(c.cast("double"))
    off = lambda name, r: F.greatest(share(F.col(value) < F.col(name)) - r, r - share(F.col(value) <= F.col(name)), F.lit(0.0)).alias(name)
    return met.groupBy(*keys).agg(*[off(name, r) for name, r in ranks.items()])


def age_label(seconds: Column) -> Column:
    return (
        F.when(seconds < 10, "now")
        .when(seconds < 60, F.concat(seconds.cast("long").cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))
    )


def day_label(day: Column, as_of: Column) -> Column:
    """Today, Yesterday, the weekday within a week, else month and day, of a date or its text; other texts stay as they are."""
    date = F.to_date(F.try_to_timestamp(day.cast("string"), F.lit("yyyy-MM-dd")))
    days = F.datediff(F.to_date(as_of), date)
    label = F.when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.date_format(date, "EEE")).otherwise(F.date_format(date, "MMM d"))
    return F.when(date.isNull(), day.cast("string")).otherwise(label)


def usd_label(c: Column) -> Column:
    """Dollars with 2 digits from 1 on, 3 from a cent on, 4 to 9 below, so that some stay; $0.00 for nothing, less or no number."""
    usd = c.cast("double")
    fixed = lambda n: F.format_string(f"$%.{n}f", usd)
    digits = F.least(F.lit(9), F.greatest(F.lit(4), 2 + F.ceil(-F.log10(usd)).cast("int")))
    small = fixed(9)
    for n in range(8, 3, -1):
        small = F.when(digits == n, fixed(n)).otherwise(small)
    bad = usd.isNull() | F.isnan(usd) | (usd <= 0) | (usd == float("inf"))
    return F.when(bad, "$0.00").when(usd >= 1, fixed(2)).when(usd >= 0.01, fixed(3)).otherwise(small)


def time_group(ts: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, ts)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "previous7").otherwise("older")
