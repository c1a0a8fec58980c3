"""Removal of repeated sentence spans: runs of several consecutive sentences that stand somewhere before.

A sentence ends at a line end, or at white space after one of .!? ; runs are compared by their words in lower case
(A-Z), so spacing does not matter. Every run of at least `least_sentences` sentences and `least_words` words counts, but
only the shortest one from each sentence on and the shortest one up to each sentence are hashed: within a longer run
that is repeated they cover every sentence and are repeated with it, so hashing that one would remove nothing more. A
sentence of `long_sentence` words is a run by itself. Of equal runs the first by (doc_id, position) stays; sentences that
another one covers are removed.

Passages that stand within other text, with no whole sentence of their own, are found by runs of `gram` words anywhere:
of all such runs in every window of WINDOW starts the least hash is taken (winnowing), so a shared span of
gram + WINDOW - 1 words always has a run in common, and its later places lose the words of that run.

Within a map task only the first of equal runs goes to the shuffle, so a line that a third of all documents hold sends
a row per task; equal hashes are then read as a sorted stream that keeps one hash in mind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._io import unique_rows
from gleaner.llm._text import SPACE_WORDS, U64, Words, mix, powers, signed, slices, window_min

LEAST_SENTENCES, LEAST_WORDS, LONG_SENTENCE = 2, 12, 24
#: Words of a run that may begin and end within sentences, and starts of which one is taken at least.
GRAM, WINDOW = 24, 14
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


class Sentences:
    """Of a run of texts: each sentence's first word (with an end mark) and text."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.words = w = Words(data, starts, ends, SPACE_WORDS)
        n = len(w.hash)
        after = np.zeros(n, bool)  # a word that begins a sentence
        if n:
            lines = np.concatenate(([0], np.cumsum(data == 10)))
            after[0] = True
            after[1:] = (lines[w.start[1:]] > lines[w.end[:-1]]) | _STOP[data[w.end[:-1] - 1]] | (w.text[1:] != w.text[:-1])
        self.first = np.flatnonzero(after)
        self.mark = np.concatenate((self.first, [n]))
        self.text = w.text[self.first]
        self.count = np.bincount(self.text, minlength=len(starts)).astype(np.int64)
        self.ptr = np.concatenate(([0], np.cumsum(self.count)))


def _winnowed(text: np.ndarray, h: np.ndarray, gram: int) -> np.ndarray:
    """Starts of runs of `gram` words whose hash is the least of a window of WINDOW starts that lies within one text."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = np.where(text[:n] == text[WINDOW + gram - 2 :], window_min(h, WINDOW), U64(0))
    pad = np.zeros(WINDOW - 1, U64)
    return np.flatnonzero(~window_min(~np.concatenate((pad, least, pad)), WINDOW) == h)


def runs(s: Sentences, least_sentences: int, least_words: int, long_sentence: int, gram: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, hash) of every run, each once."""
    n = len(s.first)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    i = np.arange(n)
    begin, end = s.ptr[s.text], s.ptr[s.text + 1]  # the text's sentences
    to = np.maximum(i + least_sentences, np.searchsorted(s.mark, s.first + least_words))
    back = np.minimum(i + 1 - least_sentences, np.searchsorted(s.mark, s.mark[i + 1] - least_words, side="right") - 1)
    ok, ok_back = to <= end, back >= begin
    alone = s.mark[i + 1] - s.first >= long_sentence
    a = np.concatenate((i[ok], back[ok_back], i[alone]))
    b = np.concatenate((to[ok] - 1, i[ok_back], i[alone]))
    w = s.words
    p, inverse = powers(len(w.hash) + 1)
    pre = np.zeros(len(w.hash) + 1, U64)
    np.cumsum(w.hash * p[: len(w.hash)], out=pre[1:])
    hashed = lambda x, y: mix((pre[y] - pre[x]) * inverse[x] + (y - x).astype(U64))
    x, y = s.mark[a], s.mark[b + 1]
    if gram and len(w.hash) >= gram:
        at = np.arange(len(w.hash) - gram + 1)
        at = _winnowed(w.text, hashed(at, at + gram), gram)
        x, y = np.concatenate((x, at)), np.concatenate((y, at + gram))
    pairs = np.unique(x * (len(w.hash) + 1) + y)
    x, y = pairs // (len(w.hash) + 1), pairs % (len(w.hash) + 1)
    return x, y, hashed(x, y)


def _run_rows(*least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held, count = [], 0
            for i, _, data, starts, ends in slices(batch.column(1)):
                s = Sentences(data, starts, ends)
                a, b, h = runs(s, *least)
                base = s.words.ptr[s.words.text[a]]
                held.append((ids[s.words.text[a] + i], a - base, b - base, h))
                count += len(a)
                if count > 1_000_000:
                    yield _local(held)
                    held, count = [], 0
            if count:
                yield _local(held)

    return run


def _local(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    doc, a, b, h = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((a, doc, h))
    doc, a, b, h = doc[order], a[order], b[order], h[order]
    late = np.concatenate(([False], h[1:] == h[:-1]))
    # a later one is removed whatever the rest of the corpus holds: it travels under a hash of its own
    own = mix(doc.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + a.astype(U64)) ^ h
    return pa.RecordBatch.from_arrays([pa.array(signed(np.where(late, own, h))), pa.array(doc, pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(late)], ["h", "key", "a", "b", "late"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(0).to_numpy(zero_copy_only=False)
        late = batch.column(4).to_numpy(zero_copy_only=False).copy()
        late[1:] |= h[1:] == h[:-1]
        late[0] |= last is not None and h[0] == last
        last = h[-1]
        yield batch.select([1, 2, 3]).filter(pa.array(late))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(2).to_pylist()
        total, gone, texts, row = [], [], [], 0
        for i, j, data, starts, ends in slices(batch.column(1)):
            s = Sentences(data, starts, ends)
            for r in range(j - i):
                body = data[starts[r] : ends[r]].tobytes()
                n = int(s.count[r])
                lost = 0
                if spans[row]:
                    lo, hi = s.words.ptr[r], s.words.ptr[r + 1]
                    cut = np.zeros(hi - lo + 1, np.int64)
                    for x in spans[row]:
                        cut[x["a"]] += 1
                        cut[x["b"]] -= 1
                    out = np.cumsum(cut[:-1]) > 0
                    lost = int(np.logical_or.reduceat(out, s.first[s.ptr[r] : s.ptr[r + 1]] - lo).sum())
                    # a word reaches to the next one's start; what stands before the first one stays
                    at = np.concatenate((s.words.start[lo:hi] - starts[r], [len(body)]))
                    edge = at[np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0))].tolist()
                    body = b"".join(body[a:b] for a, b in zip([0, *edge[1::2]], [*edge[::2], len(body)], strict=True))
                total.append(n)
                gone.append(lost)
                texts.append(body.decode())
                row += 1
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])


def remove_repeated_spans(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, long_sentence: int = LONG_SENTENCE, gram: int = 0) -> DataFrame:
    """Of each document its sentences, those removed, and the text without them.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_sentences, n_removed, text, a row for every row of
    docs. A null text counts as empty. Rows with a null or repeated doc_id are documents like others, nulls coming last:
    of equal rows the first one keeps its sentences. n_removed counts the sentences that lose words: all of them, or with `gram` (0: none) the part that
    a repeated run of so many words covers. Repeats within a document count as well.
    """
    docs = unique_rows(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("key", "text").mapInArrow(_run_rows(least_sentences, least_words, long_sentence, gram), "h long, key long, a int, b int, late boolean")
    late = rows.repartition(parts, "h").sortWithinPartitions("h", "key", "a").mapInArrow(_later, "key long, a int, b int")
    spans = late.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_sentences long, n_removed long, text string")
