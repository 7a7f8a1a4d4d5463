"""Benchmark decontamination: a block-max BM25 index of test items is asked with every passage; what it retrieves is verified."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, per_batch, table
from .license_scan import split

K1, B = 1.2, 0.75
#: Items of a block, whose greatest weights bound what the block's items can score.
BLOCK = 8
#: Words of items in one index part; larger benchmarks are asked in several parts, one after the other.
PART_WORDS = 500_000
#: Passages have at least so many words and start at every half of that. Items longer than the half go into an index of
#: their own for each doubling, with longer passages, so one long item doesn't lengthen those of all.
PASSAGE = 128
#: An item is found when a passage holds SHARE of its five-word shingles, or of its words in order, and PART_SHARE at least of question and of answer.
SHINGLE, SHARE, PART_SHARE = 5, 0.75, 0.5
#: Documents are asked together until they have so many words.
CHUNK_WORDS = 100_000
_EPS = 1e-9


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words without its last sentence, and those; with one sentence only, the last third is the answer."""
    parts = [w for w in (split(s) for s in re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    ws = split(text)
    k = len(ws) - max(1, len(ws) // 3) if ws else 0
    return ws[:k], ws[k:]


def least_share(weights: list[tuple[float, int]], n: int) -> float:
    """The least share of its own score that an item of n words keeps with SHARE of its words. weights: (weight, occurrences) by word.

    The heaviest words go first, and the last of them in part, so no choice of words to lose leaves less.
    """
    total = left = sum(w for w, _ in weights)
    may_go = n - math.ceil(SHARE * n - _EPS)
    for w, k in sorted(weights, key=lambda x: -x[0] / x[1]):
        taken = min(k, may_go)
        left -= w * taken / k
        may_go -= taken
    return left / total


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Index:
    """Postings of items as arrays: by term, the items with their weight; by term, the blocks with the greatest weight in
    them; and by term, the greatest weight of all.

    A weight is a share of the least score that a passage must reach for the item: 1 in all retrieves it.
    """

    def __init__(self, items: list[tuple[int | None, str]], df: dict[bytes, int], n: int, mean: float):
        items = sorted(items, key=lambda r: (len(split(r[1])), r[0] is None, r[0] or 0, r[1]))
        self.ids = [i for i, _ in items]
        self.vocabulary = _Vocabulary()
        self.words, self.questions, self.codes = [], [], []
        by_term: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, (_, text) in enumerate(items):
            question, answer = question_answer(text)
            ws = question + answer
            held = Counter(ws)
            weights = {}
            for w, tf in held.items():
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean))
            least = sum(weights.values()) * least_share([(x, held[w]) for w, x in weights.items()], len(ws))
            for w, x in sorted(weights.items()):
                by_term[self.vocabulary.setdefault(w, len(self.vocabulary))].append((i, x / least))
            self.words.append(np.array([self.vocabulary[w] for w in ws], dtype=np.int32))
            self.questions.append(len(question))
            self.codes.append(_codes(self.words[-1], min(SHINGLE, len(ws))))
        self.start, self.item, self.weight = self._flat([by_term[t] for t in range(len(by_term))])
        maxima = []
        for t in range(len(by_term)):
            best: dict[int, float] = {}
            for i, x in by_term[t]:
                best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), x)
            maxima.append(sorted(best.items()))
        self.block_start, self.block, self.block_weight = self._flat(maxima)
        self.most = np.array([max(x for _, x in m) for m in maxima])
        self.stride = max([PASSAGE // 2, *map(len, self.words)])

    @staticmethod
    def _flat(lists: list[list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        flat = [y for x in lists for y in x]
        return start, np.array([i for i, _ in flat], dtype=np.int64), np.array([w for _, w in flat], dtype=np.float64)

    @staticmethod
    def _expand(start: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry of term, the places of its list, and the entry each belongs to."""
        n = start[term + 1] - start[term]
        owner = np.repeat(np.arange(len(term)), n)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + start[term][owner]

    @staticmethod
    def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        return key[first], np.add.reduceat(weight, first) if len(first) else np.empty(0)

    def _bounds(self, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, block) keys that occur in the terms' lists, and the sums of the block maxima there."""
        owner, place = self._expand(self.block_start, term)
        return self._sums(window[owner] * (len(self.ids) // BLOCK + 1) + self.block[place], self.block_weight[place])

    def retrieve(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(document, first word of the passage, item, score) of all that reach 1. docs: numbers of words, -1 for others.

        Block-max pruning as WAND does it, with the split of terms that MaxScore makes in place of WAND's pivot among cursors: the
        threshold is fixed, so nothing is won by walking items in order, and many passages take each step together. A
        passage's terms are ordered by their greatest weights; the first ones, whose greatest weights together stay under 1, can
        retrieve nothing alone. So blocks are found through the other terms' lists only. Such a block is looked at when its
        maxima there and all greatest weights of the first terms reach 1, is opened when the maxima in all lists do, and
        only then are its items scored.
        """
        s, terms, blocks = self.stride, len(self.vocabulary), len(self.ids) // BLOCK + 1
        windows = [max(1, -(-len(ws) // s) - 1) for ws in docs]
        base = np.concatenate([[0], np.cumsum(windows)]).astype(np.int64)
        keys = []
        for d, ws in enumerate(docs):
            at = np.flatnonzero(ws >= 0)
            t, half = ws[at].astype(np.int64), at // s
            for w in (half, half - 1):  # a passage is two strides long
                ok = (w >= 0) & (w < windows[d])
                keys.append((base[d] + w[ok]) * terms + t[ok])
        key = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        if not len(key):
            return []
        window, term = key // terms, key % terms
        order = np.lexsort((self.most[term], window))
        window, term = window[order], term[order]
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        total = np.cumsum(self.most[term])
        before = np.repeat(total[first] - self.most[term][first], np.diff([*first, len(window)]))
        after = total - before >= 1 - _EPS
        rest = np.bincount(window[~after], self.most[term][~after], base[-1])
        looked, bound = self._bounds(window[after], term[after])
        looked = looked[bound + rest[looked // blocks] >= 1 - _EPS]
        mine = np.isin(window, looked // blocks)
        window, term = window[mine], term[mine]
        open_, bound = self._bounds(window, term)
        open_ = np.intersect1d(open_[bound >= 1 - _EPS], looked, assume_unique=True)
        mine = np.isin(window, open_ // blocks)
        window, term = window[mine], term[mine]
        owner, place = self._expand(self.start, term)
        inside = np.isin(window[owner] * blocks + self.item[place] // BLOCK, open_)
        pair, score = self._sums((window[owner] * len(self.ids) + self.item[place])[inside], self.weight[place][inside])
        good = score >= 1 - _EPS
        pair, score = pair[good], score[good]
        w = pair // len(self.ids)
        d = np.searchsorted(base, w, side="right") - 1
        return list(zip(d.tolist(), ((w - base[d]) * s).tolist(), (pair % len(self.ids)).tolist(), score.tolist(), strict=True))

    def overlap(self, item: int, passage: np.ndarray) -> float:
        """The share of the item that the passage holds, or 0 if the whole, the question or the answer isn't held enough."""
        ws, q = self.words[item], self.questions[item]
        codes, k = self.codes[item], min(SHINGLE, len(ws))
        enough = lambda held: all(h >= PART_SHARE * n for h, n in zip(held, (q, len(ws) - q), strict=True))
        found = np.isin(codes, _codes(passage, k)) if len(passage) >= k else np.zeros(len(codes), bool)
        if found.mean() >= SHARE - _EPS:
            covered = np.zeros(len(ws), bool)
            for i in range(k):
                covered[i : i + len(found)] |= found
            if enough((covered[:q].sum(), covered[q:].sum())):
                return float(found.mean())
        held = in_order(ws, passage, q)
        share = sum(held) / len(ws)
        return share if share >= SHARE - _EPS and enough(held) else 0.0

    def find(self, docs: list[list[bytes]]) -> list[dict[int, tuple[float, float]]]:
        """Per document, by item: (score, overlap) of the items that are verified in some passage."""
        found: list[dict[int, tuple[float, float]]] = [{} for _ in docs]
        known = [np.fromiter(map(self.vocabulary.__getitem__, ws), dtype=np.int32, count=len(ws)) for ws in docs]
        for d, start, item, score in self.retrieve(known):
            share = self.overlap(item, known[d][start : start + 2 * self.stride])
            if share:
                found[d][item] = max(found[d].get(item, (0.0, 0.0)), (score, share))
        return found


def _codes(ws: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code for each run of k words; runs of the same words have the same."""
    n = len(ws) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (ws[i : i + n].astype(np.int64) + 2).astype(np.uint64)
    return out


def in_order(ws: np.ndarray, passage: np.ndarray, question: int) -> tuple[int, int]:
    """The longest run of the item's words that stand in the passage in order, gaps allowed: how many are from question and answer.

    Bit i of v is 0 where the i-th word makes the longest common subsequence longer; each word of the passage takes a few
    operations on an integer of as many bits as the item has words.
    """
    places: dict[int, int] = defaultdict(int)
    for i, w in enumerate(ws.tolist()):
        places[w] |= 1 << i
    full = (1 << len(ws)) - 1
    v = full
    for w in passage.tolist():
        if m := places.get(w):
            both = v & m
            v = ((v + both) | (v - both)) & full
    zeros = ~v & full
    q = (zeros & ((1 << question) - 1)).bit_count()
    return q, zeros.bit_count() - q


def indexes(items: DataFrame):
    """Parts one by one, each a list of indexes by length; document frequencies and the mean length are those of all items. items: item_id, text."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(w, len(ws) if k == 0 else 0, int(k == 0)) for ws in map(split, batch.column(1).to_pylist()) if ws for k, w in enumerate(sorted(set(ws)))]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["word", "length", "one"])

    items = items.select(F.col("item_id").cast("long"), "text").where(F.length("text") > 0)
    counted = items.mapInArrow(per_batch(count), "word binary, length long, one long")
    n, total = counted.agg(F.sum("one"), F.sum("length")).first()
    if not n:
        return
    parts = -(-total // PART_WORDS)
    df = counted.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        words = mine.mapInArrow(per_batch(count), "word binary, length long, one long").select("word").distinct()
        found = {bytes(r["word"]): r["df"] for r in df.join(words, "word").toLocalIterator()}
        classes: dict[int, list[tuple[int | None, str]]] = defaultdict(list)
        for r in mine.toLocalIterator():
            if length := len(split(r["text"])):
                classes[max(0, (length - 1) // (PASSAGE // 2)).bit_length()].append((r["item_id"], r["text"]))
        yield [Index(rows, found, n, total / n) for _, rows in sorted(classes.items())]


_FOUND = "array<struct<item_id:bigint,score:double,overlap:double>>"


def annotate(df: DataFrame, items: DataFrame, text: str = "text", to: str = "found_items") -> DataFrame:
    """df with column `to` (an existing one is replaced): the benchmark items verified in each row's text, with score and overlap, by item.

    The score is BM25 as a share of the least that a passage with SHARE of the item's words can have. Null and empty texts, and
    empty benchmarks, find nothing; repeated rows and items each give their result; an item without an id is reported with a
    null; long texts are asked passage by passage; other columns pass through under any names.
    """
    df = df.withColumn(to, F.array().cast(_FOUND))
    struct = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64())]))
    for part in indexes(items):
        shared = df.sparkSession.sparkContext.broadcast(part)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            part, before = shared.value, batch.column(to).to_pylist()
            rows, waiting, n = [], [], 0

            def ask():
                found = [[] for _ in waiting]
                for index in part:
                    for mine, r in zip(found, index.find(waiting), strict=True):
                        mine += [{"item_id": index.ids[i], "score": s, "overlap": o} for i, (s, o) in sorted(r.items())]
                rows.extend(found)

            for t in batch.column(text):
                waiting.append(split(t.as_py()))
                n += len(waiting[-1])
                if n >= CHUNK_WORDS:
                    ask()
                    waiting, n = [], 0
            ask()
            return batch.set_column(batch.schema.names.index(to), to, pa.array([a + b for a, b in zip(before, rows, strict=True)], struct))

        df = df.mapInArrow(per_batch(run), df.schema)
    return df


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the benchmark items that its text holds, and whether it holds any. annotate() says what awkward rows give."""
    found = annotate(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), table(spark, sf_dir, "benchmark"))
    best = F.array_max(F.transform("found_items", lambda x: F.struct(x["overlap"].alias("overlap"), x["score"].alias("score"), (-x["item_id"]).alias("id"))))
    return found.select(
        "doc_id",
        (F.size("found_items") > 0).alias("contaminated"),
        F.size("found_items").cast("long").alias("n_items"),
        F.array_sort(F.transform("found_items", lambda x: x["item_id"])).alias("item_ids"),
        (-best["id"]).alias("best_item"),
        best["overlap"].alias("best_overlap"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that hold a benchmark item go; annotate() says what awkward rows give."""
    to = fresh(docs, "found_items")
    return annotate(docs, table(spark, sf_dir, "benchmark"), to=to).where(F.size(to) == 0).select([f"`{c}`" for c in docs.columns])
