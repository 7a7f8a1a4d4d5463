"""Cumulative-link ordinal regression over sparse word features: one weight vector, ordered thresholds, expected severity."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, stored, table
from .license_scan import split

#: Besides whole words, features are their beginnings of so many bytes, so that unseen endings of a known stem count.
STEMS = (4, 5, 6)
#: Bound of the fit: labelled rows, those with the smallest id hashes. All features that stand out in them are kept.
LABELLED = 20_000
#: A word becomes a feature when its log odds between toxic and other texts are so many standard errors from 0.
MIN_Z = 4.0
#: A document is toxic when P(grade > 0) reaches this.
REJECT = 0.5


def terms(text: str | None) -> list[bytes]:
    """The words of a text, and the beginnings of its longer words, each behind a mark that no word holds."""
    ws = split(text)
    return [*ws, *(b"^" + w[:n] for n in STEMS for w in ws if len(w) >= n)]


def sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(grade, text) of at most `most` labelled documents, written once. labels: doc_id, toxic, the grade: 0 for clean, then any whole numbers.

    A document labelled twice has the highest grade. Of several texts under one id the one with the least hash is taken.
    """
    by_id = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.greatest(F.col("toxic").cast("int"), F.lit(0))).alias("grade"))
    chosen = by_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    held = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    return stored(held.groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text")).select("grade", "text"))


def _count(batches):
    """Per word of a task's texts: texts with it, toxic texts with it. The empty word counts all texts."""
    n, toxic = Counter(), Counter()
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {*terms(text), b""}
            n.update(found)
            if label:  # any grade but 0
                toxic.update(found)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([toxic[w] for w in n], pa.int64())], ["word", "n", "toxic"])


def features(rows: DataFrame) -> dict[bytes, int]:
    """All words whose use differs by MIN_Z between toxic and other texts, in both directions: place from 1, negative for the latter. The sample bounds them."""
    counts = rows.mapInArrow(_count, "word binary, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    total = counts.where(F.length("word") == 0).first()
    if total is None or not 0 < total["t"] < total["n"]:
        return {}
    t, c = float(total["t"]), float(total["n"] - total["t"])
    a, b = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(a / (F.lit(t + 1) - a)) - F.log(b / (F.lit(c + 1) - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    best = counts.where((F.length("word") > 0) & (F.col("n") >= 5)).withColumn("z", z).where(F.abs("z") >= MIN_Z).select("word", "z").orderBy(F.abs("z").desc(), "word").collect()
    return {bytes(r["word"]): (i + 1) * (1 if r["z"] > 0 else -1) for i, r in enumerate(best)}


class Model:
    """Weights by word, and thresholds: P(grade > k) = sigmoid(x.w - threshold[k])."""

    def __init__(self, weights: dict[bytes, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds

    def predict(self, text: str | None) -> tuple[int, float, float]:
        """(most likely grade, expected severity, P(grade > 0))."""
        counts = Counter(w for w in terms(text) if w in self.weights)
        x = sum(self.weights[w] * math.log1p(n) for w, n in sorted(counts.items()))
        above = [1 / (1 + math.exp(min(max(t - x, -500), 500))) for t in self.thresholds]
        p = [hi - lo for hi, lo in zip([1.0, *above], [*above, 0.0], strict=True)]
        return max(range(len(p)), key=lambda k: p[k]), sum(above), above[0] if above else 0.0


def _cuts(p: np.ndarray, width: int) -> np.ndarray:
    """Thresholds are a first value and positive steps, so that they stay in order."""
    return p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))])


def loss(p: np.ndarray, at: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, width: int, decay: float) -> tuple[float, np.ndarray]:
    """The mean negative log likelihood of the cumulative-link model with its decay, and the gradient. p: weights, first threshold, log steps."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    w, n, i, grades = p[:width], len(y), np.arange(len(y)), len(p) - width + 1
    x = np.bincount(at, val * w[col], n)
    above = np.concatenate([np.ones((n, 1)), sig(x[:, None] - _cuts(p, width)), np.zeros((n, 1))], axis=1)
    slope = above * (1 - above)
    prob = np.maximum(above[i, y] - above[i, y + 1], 1e-12)
    gx = -(slope[i, y] - slope[i, y + 1]) / prob
    gcut = np.zeros((n, grades + 1))
    gcut[i, y] += slope[i, y] / prob
    gcut[i, y + 1] -= slope[i, y + 1] / prob
    gc = gcut[:, 1:-1].sum(axis=0)
    steps = [gc[k + 1 :].sum() * np.exp(p[width + 1 + k]) / n for k in range(grades - 2)]
    return float(-np.log(prob).mean() + decay / 2 * (w @ w)), np.concatenate([np.bincount(col, val * gx[at], width) / n + decay * w, [gc.sum() / n], steps])


def fit_ordinal(at: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, width: int, grades: int = 2, steps: int = 400, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by full-batch Adam on the cumulative-link likelihood of a bounded sample.

    Text at[i] has value val[i] of feature col[i]; y holds the texts' grades, from 0.
    """
    p = np.concatenate([np.zeros(width), [1.0], np.zeros(grades - 2)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        _, g = loss(p, at, col, val, y, width, decay)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:width], _cuts(p, width)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows; with labels of one kind only, nothing is learned and nothing is toxic.

    Grades are the labels' own, in order; there are as many thresholds as grades above the lowest: one for labels of 0 and 1. Null ids and null labels teach nothing, null and empty texts have no words, long texts
    count whole, and empty tables give an empty model.
    """
    rows = sample(docs, labels)
    words = features(rows)
    if not words:
        return Model({}, [])
    place = {w: abs(k) - 1 for w, k in words.items()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Counter(place[w] for w in terms(t) if w in place) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["grade", "at", "n"])

    got = rows.mapInArrow(per_batch(run), "grade int, at array<int>, n array<int>").toArrow().combine_chunks()
    sizes = pc.list_value_length(got["at"]).to_numpy()
    col, n = (pc.list_flatten(got[c]).to_numpy() for c in ("at", "n"))
    levels, y = np.unique(got["grade"].to_numpy(), return_inverse=True)
    w, cuts = fit_ordinal(np.repeat(np.arange(len(got), dtype=np.int32), sizes), col, np.log1p(n).astype(np.float32), y, len(place), len(levels))
    return Model({word: float(w[k]) for word, k in place.items()}, [float(c) for c in cuts])


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, grade, severity (expected grade, in steps of the grades learned), p_toxic, toxic.

    Null and empty texts have no features and get the grade of the thresholds alone; repeated rows repeat; columns beside
    doc_id and text aren't read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.predict(t) for t in batch.column(1).to_pylist()]
        cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.float64(), pa.float64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "grade", "severity", "p_toxic"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(per_batch(run), "doc_id long, grade int, severity double, p_toxic double")
    return out.withColumn("toxic", F.col("p_toxic") >= REJECT)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all documents by a model of the labelled ones; learn() and grade() say what awkward rows give."""
    docs = table(spark, sf_dir, "documents")
    return grade(docs, learn(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that are toxic go. The text is judged where it stands, so no join on doc_id is needed."""
    model = learn(docs, table(spark, sf_dir, "labels"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [model.predict(t)[2] < REJECT for t in batch.column("text").to_pylist()]
        return batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(per_batch(run), docs.schema)
