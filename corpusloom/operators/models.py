"""Models inside Arrow workers: loaded once a worker, fed batches of texts of like length."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Texts that a model gets at once.
BATCH = 64


class Encoder(Protocol):
    """A model of texts. `name` tells models apart; load() returns what encode() needs, weights say; both run on executors."""

    name: str

    def load(self) -> Any: ...

    def encode(self, loaded: Any, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class PairScorer(Protocol):
    """A model of pairs (query, text), as a cross-encoder is."""

    name: str

    def load(self) -> Any: ...

    def score(self, loaded: Any, queries: Sequence[str], texts: Sequence[str]) -> Sequence[float]: ...


#: What this worker has loaded, by the model's name; workers serve many tasks.
_loaded: dict[str, Any] = {}


def loaded(model: Encoder | PairScorer) -> Any:
    if model.name not in _loaded:
        _loaded[model.name] = model.load()
    return _loaded[model.name]


def _in_batches(lengths: Sequence[int], run: Callable[[list[int]], Sequence], size: int) -> list:
    """run() on the places of BATCH items at a time, shortest first, so that little is padded; results in the items' own order."""
    order = np.argsort(np.array(lengths), kind="stable").tolist()
    out: list = [None] * len(order)
    for a in range(0, len(order), size):
        some = order[a : a + size]
        got = run(some)
        if len(got) != len(some):
            raise ValueError(f"the model gave {len(got)} results for {len(some)} inputs")
        for i, x in zip(some, got, strict=True):
            out[i] = x
    return out


def encode(df: DataFrame, key: str, text: str, model: Encoder, size: int = BATCH) -> DataFrame:
    """(key, vec) of the texts, as the model gives them; null texts have no row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held, texts = loaded(model), batch.column(1).to_pylist()
                vecs = _in_batches([len(t) for t in texts], lambda at: model.encode(held, [texts[i] for i in at]), size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(map(float, v)) for v in vecs], pa.list_(pa.float64()))], [key, "vec"])

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {kind}, vec array<double>")


def score_pairs(df: DataFrame, query: str, text: str, model: PairScorer, size: int = BATCH, name: str = "score") -> DataFrame:
    """df with the model's score of each (query, text); null where either is null."""
    fields = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held, pairs = loaded(model), list(zip(batch.column(query).to_pylist(), batch.column(text).to_pylist(), strict=True))
                whole = [i for i, (q, t) in enumerate(pairs) if q is not None and t is not None]
                got = _in_batches([len(pairs[i][0]) + len(pairs[i][1]) for i in whole], lambda at: model.score(held, [pairs[whole[i]][0] for i in at], [pairs[whole[i]][1] for i in at]), size)
                out: list = [None] * len(pairs)
                for i, x in zip(whole, got, strict=True):
                    out[i] = float(x)
                yield batch.append_column(name, pa.array(out, pa.float64()))

    return df.mapInArrow(run, fields)
