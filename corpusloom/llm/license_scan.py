"""Positional rare-token index over licence notices: a file's rarest licence words are looked up, places intersected, key phrases verified."""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, table

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and paragraphs of licences looked for: label, notice, key phrase that must stand in the aligned place.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses", "apache org licenses"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed under the license is distributed"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability", "authors or copyright holders be liable"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "general public license along with"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "any express or implied warranties"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "copy of the mpl was not distributed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "the author disclaims all warranties"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone is free to copy modify"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("reserved", "all rights reserved", "all rights reserved"),
)

#: Share of a notice's words that must stand in their order around its key phrase, and words beside as many as the notice has on
#: a side that may stand between them there.
COVER, BETWEEN = 0.6, 16

_TO_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text whose A-Z are lower-cased."""
    return text.encode("utf-8", "replace").translate(_TO_SPACE).split(b" ") if text else []


def split(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


def _place(notice: list[bytes], key: list[bytes]) -> int:
    return next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)


#: (label, words, key phrase, its place).
_NOTICES = [(label, ws, key, _place(ws, key)) for label, ws, key in ((label, notice.encode().split(), key.encode().split()) for label, notice, key in NOTICES)]
_BASE = [(phrase.encode().split(), label) for phrase, label in BASE.items()]
VOCABULARY = frozenset(w for _, ws, *_ in _NOTICES for w in ws) | {w for ws, _ in _BASE for w in ws}


def _count(batches):
    """Documents and, per vocabulary word, documents with it: one row for each word of a task."""
    n, df = 0, defaultdict(int)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n += 1
            for w in VOCABULARY.intersection(words(text)):
                df[w] += 1
    if n:
        df[b""] = n
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in df]), "n": pa.array(list(df.values()), pa.int64())})


def idf(docs: DataFrame) -> dict[bytes, float]:
    """IDF of each vocabulary word over all documents; the vocabulary bounds what reaches the driver."""
    counts = {r["word"].encode(): r["n"] for r in docs.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = counts.get(b"", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in VOCABULARY}


Index = tuple[dict[bytes, list[tuple[int, int]]], dict[bytes, float]]


def build_index(weights: dict[bytes, float]) -> Index:
    """Postings word -> (notice, place in its key phrase), and the words' IDF. No notice counts without its key phrase, so no other words are posted."""
    index = defaultdict(list)
    for i, (_, _, key, _) in enumerate(_NOTICES):
        for q, w in enumerate(key):
            index[w].append((i, q))
    return dict(index), weights


def rare_places(ws: list[bytes], at: list[int], weights: dict[bytes, float]) -> list[int]:
    """Of each two licence words that stand side by side, the place of the rarer one, the first of equals; at: places of licence words.

    As a key phrase has two words at least, each place where one stands keeps a word of it, whatever stands around.
    """
    kept = {p if weights[ws[p]] >= weights[ws[q]] else q for p, q in zip(at, at[1:]) if q == p + 1}
    return sorted(kept)


def _masks(part: list[bytes]) -> dict[bytes, int]:
    masks = defaultdict(int)
    for i, w in enumerate(part):
        masks[w] |= 1 << i
    return dict(masks)


#: Of each notice the words before its key phrase, backwards, and those after it, as bits by word.
_SIDES = [((_masks(ws[:k][::-1]), k), (_masks(ws[k + len(key) :]), len(ws) - k - len(key))) for _, ws, key, k in _NOTICES]


def in_order(masks: dict[bytes, int], n: int, window: list[bytes]) -> int:
    """How many of a part's n words stand in the window in their order: the longest common subsequence, a bit for each word."""
    full = (1 << n) - 1
    open_ = full
    for w in window:
        hit = open_ & masks.get(w, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return n - open_.bit_count()


def match(ws: list[bytes], at: list[int], index: Index) -> tuple[set[str], float]:
    """Labels of verified notices and the best share of a notice's words in order. at: places of licence words.

    Postings of the rarest words agree on where key phrases would start; where one stands whole, the notice is aligned
    on both sides of it.
    """
    postings, weights = index
    starts = {(i, p - q) for p in rare_places(ws, at, weights) for i, q in postings.get(ws[p], ())}
    labels, best = set(), 0.0
    for i, p in starts:
        label, notice, key, k = _NOTICES[i]
        if p < 0 or ws[p : p + len(key)] != key:
            continue
        (before, n), (after, m) = _SIDES[i]
        end = p + len(key)
        found = len(key) + in_order(before, n, ws[max(0, p - 2 * n - BETWEEN) : p][::-1] if n else []) + in_order(after, m, ws[end : end + 2 * m + BETWEEN] if m else [])
        if found >= COVER * len(notice):
            labels.add(label)
            best = max(best, found / len(notice))
    return labels, best


def base_places(ws: list[bytes], at: list[int]) -> list[tuple[int, str]]:
    return [(p, label) for p in at for phrase, label in _BASE if ws[p] == phrase[0] and ws[p : p + len(phrase)] == phrase]


def scan_text(text: str | None, index: Index) -> tuple:
    ws = split(text)
    at = [p for p, w in enumerate(ws) if w in VOCABULARY]
    places = base_places(ws, at)
    labels, score = match(ws, at, index)
    starts, base = [p for p, _ in places], {label for _, label in places}
    return len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def find_licenses(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Two passes: IDF over all documents, then each text against the notices' postings. Empty and null texts have no words
    and no labels; long texts are read whole; repeated rows repeat; an empty table gives no rows; other columns, whatever
    their names, are ignored.
    """
    index = build_index(idf(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan_text(t, index) for t in batch.column(1).to_pylist()]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(per_batch(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_licenses() of all documents; its docstring says what nulls, empty and long texts and repeated rows give."""
    return find_licenses(table(spark, sf_dir, "documents"))
