"""A text classifier trained on a bounded sample of labelled rows and applied to whole texts.

Features are style measures of the whole text and, per class, how far the text's words speak for it: log-odds of
hashed words from one half of the sample, summed up as mean, maximum and the number of strong words. A softmax
regression on the other half weighs them, so that the words' odds are never judged on the texts they come from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm._text import SPACE_WORDS, U64, Words, slices

#: Labelled documents that a model is fitted on at most: those of the least hashes of doc_id.
MOST_LABELLED = 6000
BUCKETS = 1 << 18
_STRONG = 1.5
_CLASSES = [np.array([c in s for c in range(256)]) for s in (range(65, 91), b"!", range(48, 58), b".,;:?", b"\n", [*b"\"#$%&'()*+-/<=>@[]\\^_`{|}~"], range(128, 256), range(97, 123))]
STYLE = 5 + len(_CLASSES)


def _style(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: Words) -> np.ndarray:
    n = len(starts)
    out = np.zeros((n, STYLE))
    size, count = np.maximum(ends - starts, 1), words.count
    sums = lambda x, at: (c := np.concatenate(([0], np.cumsum(x))))[at[1:]] - c[at[:-1]]
    out[:, 0] = np.log1p(count) / 8
    out[:, 1] = np.minimum((sums(words.end - words.start, words.ptr)) / np.maximum(count, 1), 40) / 10
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    out[:, 2] = sums(same, words.ptr) / np.maximum(count, 1)
    order = np.lexsort((words.hash, words.text))
    h, t = words.hash[order], words.text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    out[:, 3] = np.bincount(t[new], minlength=n) / np.maximum(count, 1)
    at, grams = words.grams(3)
    owner = words.text[at]
    order = np.lexsort((grams, owner))
    h, t = grams[order], owner[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    out[:, 4] = np.bincount(t[again], minlength=n) / np.maximum(count, 1)
    for k, kind in enumerate(_CLASSES):
        c = np.concatenate(([0], np.cumsum(kind[data])))
        out[:, 5 + k] = (c[ends] - c[starts]) / size
    return out


@dataclass
class Model:
    odds: np.ndarray  # class x bucket
    weights: np.ndarray  # feature x class
    center: np.ndarray
    scale: np.ndarray

    def features(self, style: np.ndarray, words: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """words: bucket of each word of all texts; ptr: where each text's begin."""
        n = len(ptr) - 1
        count = np.maximum(np.diff(ptr), 1)
        parts = [style]
        full = np.diff(ptr) > 0
        for odds in self.odds:
            x = odds[words]
            c = np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))
            strong = np.concatenate(([0], np.cumsum(x > _STRONG)))
            most = np.zeros(n)
            if len(x):
                most[full] = np.maximum.reduceat(x, ptr[:-1][full])
            parts.append(np.stack(((c[ptr[1:]] - c[ptr[:-1]]) / count, most / 4, np.log1p(strong[ptr[1:]] - strong[ptr[:-1]]) / 2), axis=1))
        return np.concatenate(parts, axis=1)

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        z = np.concatenate(((features - self.center) / self.scale, np.ones((len(features), 1))), axis=1) @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(labels: np.ndarray, style: np.ndarray, words: list[np.ndarray], classes: int) -> Model:
    """labels: class of each sampled text; words: its distinct buckets."""
    n = len(labels)
    half = np.random.Generator(np.random.PCG64(11)).permutation(n) % 2 == 0  # no order of the rows can part the classes
    # a text counts once for a word; odds of the word's share in the class against the rest
    odds = np.zeros((classes, BUCKETS), np.float32)
    seen = np.zeros((classes, BUCKETS))
    total = np.array([(labels[half] == k).sum() for k in range(classes)], float)
    for i in np.flatnonzero(half):
        seen[labels[i], words[i]] += 1
    for k in range(classes):
        rest, rest_total = seen.sum(axis=0) - seen[k], total.sum() - total[k]
        odds[k] = np.log((seen[k] + 0.1) / (total[k] + 0.2)) - np.log((rest + 0.1) / (rest_total + 0.2))
        odds[k][seen.sum(axis=0) < 3] = 0
    model = Model(odds, np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    ptr = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    x = model.features(style, np.concatenate(words) if words else np.zeros(0, np.int64), ptr)
    other = ~half if n > 1 else half
    model.center, model.scale = x[other].mean(axis=0), x[other].std(axis=0) + 1e-6
    z = np.concatenate(((x - model.center) / model.scale, np.ones((n, 1))), axis=1)[other]
    y = np.eye(classes)[labels[other]]
    w = np.zeros((z.shape[1], classes))
    speed, rate = np.zeros_like(w), 0.3
    for _ in range(400):  # Nesterov steps of a ridge softmax regression
        at = w + 0.9 * speed
        s = z @ at
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - rate * (z.T @ (p - y) / len(z) + 1e-3 * at)
        w = w + speed
    model.weights = w
    return model


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, starts, ends in slices(batch.column(1)):
            words = Words(data, starts, ends, SPACE_WORDS)
            style = _style(data, starts, ends, words)
            bucket = (words.hash & U64(BUCKETS - 1)).astype(np.int32)
            each = [np.unique(bucket[words.ptr[r] : words.ptr[r + 1]]) for r in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(list(style)), pa.array(each, pa.list_(pa.int32()))], ["doc_id", "label", "style", "words"])


def train(docs: DataFrame, labels: DataFrame, label: Column, classes: int, most: int = MOST_LABELLED) -> Model | None:
    """A model of `label` (0 to classes - 1, null: not labelled), or None where no labelled text is found."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = given.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    found = rows.mapInArrow(_sample_rows, "doc_id long, label int, style array<double>, words array<int>").toArrow()  # at most `most` texts' features
    if not found.num_rows:
        return None
    found = found.sort_by([("doc_id", "ascending")])
    style = np.array(found.column("style").to_pylist())
    words = found.column("words").combine_chunks()
    off, flat = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False)
    return fit(found.column("label").to_numpy(), style, [flat[a:b].astype(np.int64) for a, b in zip(off[:-1], off[1:], strict=True)], classes)


def _apply(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            row = batch.column(0)
            probs, counts = [np.zeros((0, m.weights.shape[1]))], []
            for _, _, data, starts, ends in slices(row.field("text")):
                words = Words(data, starts, ends, SPACE_WORDS)
                x = m.features(_style(data, starts, ends, words), (words.hash & U64(BUCKETS - 1)).astype(np.int64), words.ptr)
                probs.append(m.posteriors(x))
                counts.append(words.count)
            p = np.concatenate(probs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([row, lists, pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())], ["row", "p", "n_words"])

    return run


def classified(docs: DataFrame, model: Model | None, classes: int, columns: list[str] | None = None) -> DataFrame:
    """(row struct of the columns, p array of class posteriors, n_words) of every row; without a model p is even."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"))
    if model is None:
        empty = np.zeros((STYLE + 3 * classes + 1, classes))
        model = Model(np.zeros((classes, BUCKETS), np.float32), empty, np.zeros(len(empty) - 1), np.ones(len(empty) - 1))
    schema = T.StructType([*rows.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("n_words", T.LongType())])
    return rows.mapInArrow(_apply(spark.sparkContext.broadcast(model)), schema)
