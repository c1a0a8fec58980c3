"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003).

An item's windows are its runs of 13 words. Every window keeps one fingerprint: the least of the hashes of its 5-word
grams. A document's windows are fingerprinted the same way, so a span of 13 shared words always gives a shared
fingerprint. Fingerprints are joined, and each hit is extended to the full windows around it, whose words are compared
by a 64-bit hash of all of them.

A benchmark of up to `most_bytes` of text (checked before) is an index of bounded size that every task holds; the join
is a lookup while the documents stream by, without a shuffle. A larger one is joined as tables, and only documents
that share a fingerprint meet the items they share it with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm._io import spread_join
from gleaner.llm._text import _WORD_MULT, ALNUM_WORDS, U64, Words, mix, signed, slices, window_min

WINDOW, GRAM = 13, 5
#: Benchmark text that an index in each task may be built from.
MOST_BYTES = 8 << 20
_BITS = 1 << 20
#: Stands where a passage was cut out; a word by itself, so that what it parts gives no new window.
OMITTED = "…"
MEASURES = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


@dataclass
class Index:
    """Of a benchmark's windows: by length the sorted hashes and the items of each, and the fingerprints of full ones."""

    hashes: dict[int, np.ndarray]
    items: dict[int, list[tuple[int, ...]]]
    prints: np.ndarray
    table: np.ndarray


def _gram_hash(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    g = np.zeros(len(at), U64)
    for j in range(k):
        g = g * _WORD_MULT + hashes[at + j]
    return mix(g + U64(k))


def _prints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of every full window."""
    n = len(words.hash) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    least = window_min(_gram_hash(words.hash, np.arange(len(words.hash) - GRAM + 1), GRAM), WINDOW - GRAM + 1)
    at = np.flatnonzero(words.text[:n] == words.text[WINDOW - 1 :])
    return at, least[at]


def build(ids: list[int], texts: list[str | None]) -> Index:
    by: dict[int, dict[int, set[int]]] = {}
    prints: list[np.ndarray] = [np.zeros(0, U64)]
    for i, j, data, starts, ends in slices(pa.array(texts, pa.string())):
        words = Words(data, starts, ends, ALNUM_WORDS)
        at, least = _prints(words)
        prints.append(least)
        for text, h in zip(words.text[at].tolist(), _gram_hash(words.hash, at, WINDOW).tolist(), strict=True):
            by.setdefault(WINDOW, {}).setdefault(h, set()).add(ids[i + text])
        for r in np.flatnonzero((words.count > 0) & (words.count < WINDOW)).tolist():
            m = int(words.count[r])
            h = int(_gram_hash(words.hash, words.ptr[r : r + 1], m)[0])
            by.setdefault(m, {}).setdefault(h, set()).add(ids[i + r])
    hashes = {m: np.array(sorted(x), U64) for m, x in by.items()}
    table = np.zeros(_BITS, bool)
    found = np.unique(np.concatenate(prints))
    table[(found & U64(_BITS - 1)).astype(np.int64)] = True
    return Index(hashes, {m: [tuple(sorted(x[h])) for h in hashes[m].tolist()] for m, x in by.items()}, found, table)


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted array, or -1."""
    if not len(among):
        return np.full(len(values), -1)
    i = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[i] == values, i, -1)


def measure(words: Words, index: Index, n: int) -> tuple[np.ndarray, list[set[int]], np.ndarray, np.ndarray]:
    """Of n texts: words within a window's occurrences, the items whose windows occur, if a full window does; and of each word if it is within."""
    full = np.zeros(n, bool)
    cover = np.zeros(len(words.hash) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(n)]

    def extend(at: np.ndarray, m: int) -> None:
        hit = _within(_gram_hash(words.hash, at, m), index.hashes.get(m, np.zeros(0, U64)))
        for a, w in zip(at[hit >= 0].tolist(), hit[hit >= 0].tolist(), strict=True):
            cover[a] += 1
            cover[a + m] -= 1
            items[words.text[a]].update(index.items[m][w])
            full[words.text[a]] |= m == WINDOW

    at, least = _prints(words)
    near = index.table[(least & U64(_BITS - 1)).astype(np.int64)]
    at, least = at[near], least[near]
    extend(at[_within(least, index.prints) >= 0], WINDOW)
    for m in index.hashes:
        if m < WINDOW and len(words.hash) >= m:
            n_at = len(words.hash) - m + 1
            extend(np.flatnonzero(words.text[:n_at] == words.text[m - 1 :]), m)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(words.text[inside], minlength=n), items, full, inside


def _left(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: Words, inside: np.ndarray) -> list[str | None]:
    """Each text with OMITTED for every run of words within a window; null for a text without any."""
    out: list[str | None] = [None] * len(starts)
    for r in np.unique(words.text[inside]).tolist():
        at = words.ptr[r]
        edge = np.flatnonzero(np.diff(inside[at : words.ptr[r + 1]].astype(np.int8), prepend=0, append=0)) + at
        parts, done = [], int(starts[r])
        for a, b in zip(words.start[edge[::2]].tolist(), words.end[edge[1::2] - 1].tolist(), strict=True):
            parts += [data[done:a].tobytes(), OMITTED.encode()]
            done = b
        out[r] = b"".join([*parts, data[done : ends[r]].tobytes()]).decode()
    return out


def _columns(counts: list[int], hits: list[int], items: list[set[int]]) -> list[pa.Array]:
    digests = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
    bad = [h > 0 and 20 * h >= n for h, n in zip(hits, counts, strict=True)]
    return [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array(bad, pa.bool_())]


def _measured(row: pa.Array, counts: list[int], hits: list[int], items: list[set[int]], full: list[bool], left: list[str | None]) -> pa.RecordBatch:
    left = left or [None] * len(counts)
    leak = pa.StructArray.from_arrays(_columns(counts, hits, items), _NAMES)
    return pa.RecordBatch.from_arrays([row, leak, pa.array(full, pa.bool_()), pa.array(left, pa.string())], ["row", "leak", "full", "left"])


def _lookup(index, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            row = batch.column(0)
            counts, hits, items, full, left = [], [], [], [], []
            for i, j, data, starts, ends in slices(row.field("text")):
                words = Words(data, starts, ends, ALNUM_WORDS)
                h, x, f, inside = measure(words, found, j - i)
                counts += words.count.tolist()
                hits += h.tolist()
                full += f.tolist()
                items += x
                left += _left(data, starts, ends, words, inside) if texts else ()
            yield _measured(row, counts, hits, items, full, left)

    return run


_NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def _own_items(texts: bool):
    """Each row against the items that share a fingerprint with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, shared = batch.column(0), batch.column(1).to_pylist()
            counts, hits, items, full, left = [], [], [], [], []
            for i, text in enumerate(row.field("text").to_pylist()):
                alone = _alone(text)
                words = Words(*alone, ALNUM_WORDS)
                counts.append(int(words.count[0]))
                if shared[i]:
                    h, x, f, inside = measure(words, build([s["item_id"] for s in shared[i]], [s["item"] for s in shared[i]]), 1)
                    hits.append(int(h[0]))
                    full.append(bool(f[0]))
                    items += x
                    left += _left(*alone, words, inside) if texts else [None]
                else:
                    hits.append(0)
                    full.append(False)
                    items.append(set())
                    left.append(None)
            yield _measured(row, counts, hits, items, full, left)

    return run


def _alone(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return data, np.zeros(1, np.int64), np.array([len(data)])


def _print_rows(lengths: list[int]):
    """(id, length of the gram, hash): fingerprints of full windows, and all grams of the given shorter lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, starts, ends in slices(batch.column(1)):
                words = Words(data, starts, ends, ALNUM_WORDS)
                found = [(WINDOW, *_prints(words))]
                for m in lengths:
                    n = len(words.hash) - m + 1
                    if n > 0:
                        at = np.flatnonzero(words.text[:n] == words.text[m - 1 :])
                        found.append((m, at, _gram_hash(words.hash, at, m)))
                for m, at, h in found:
                    rows = np.unique(np.stack((words.text[at] + i, signed(h))), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows[0]]), pa.array(np.full(rows.shape[1], m, np.int32)), pa.array(rows[1])], ["id", "m", "h"])

    return run


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows = []
        for i, text in enumerate(batch.column(1).to_pylist()):
            words = Words(*_alone(text), ALNUM_WORDS)
            m = int(words.count[0])
            if m >= WINDOW:
                rows += [(ids[i], WINDOW, h) for h in np.unique(signed(_prints(words)[1])).tolist()]
            elif m:
                rows.append((ids[i], m, int(signed(_gram_hash(words.hash, np.zeros(1, np.int64), m))[0])))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["item_id", "m", "h"])


def leaks(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES, texts: bool = False) -> DataFrame:
    """(row struct of all columns of docs, leak struct of MEASURES, full, left) for every row of docs.

    `full` tells whether a window of 13 words occurs. With `texts`, `left` is a hit text without its hit words; else,
    and for texts without a hit, it is null.

    docs: doc_id, text; benchmark: item_id, text. Null texts and texts without words have no words and no windows;
    items with a null id take no part; repeated items count once. Rows with a null or repeated doc_id are measured like
    others, each by its own text. A text is contaminated when it has a hit and a twentieth or more of its words are hit.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).where("item_id is not null and item is not null")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    more = [T.StructField("leak", T._parse_datatype_string(MEASURES)), T.StructField("full", T.BooleanType()), T.StructField("left", T.StringType())]
    out = T.StructType([*rows.schema.fields, *more])
    size = items.agg(F.sum(F.octet_length("item") + 16)).first()[0] or 0
    if size <= most_bytes:
        found = items.collect()  # of a size just checked
        index = spark.sparkContext.broadcast(build([r.item_id for r in found], [r.item for r in found]))
        return rows.mapInArrow(_lookup(index, texts), out)
    prints = items.mapInArrow(_item_rows, "item_id long, m int, h long").distinct()
    lengths = [r.m for r in prints.where(f"m < {WINDOW}").select("m").distinct().collect()]  # twelve at most
    # a text by its own hash and id: equal ids may have several texts, and a third of all rows one text
    key = lambda d, t: F.xxhash64(d.cast("long"), t.cast("string"))
    given = docs.select(key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    printed = given.mapInArrow(_print_rows(lengths), "key long, m int, h long")
    pairs = spread_join(printed, prints, ["m", "h"]).select("key", "item_id").distinct()
    shared = spread_join(pairs, items, ["item_id"]).groupBy("key").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    met = rows.join(shared, key(F.col("row.doc_id"), F.col("row.text")) == shared.key, "left").select("row", "items")
    return met.mapInArrow(_own_items(texts), out)


def leak_measures(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id and MEASURES of each row of docs; see leaks()."""
    return leaks(docs.select("doc_id", "text"), benchmark, most_bytes).select(F.col("row.doc_id").cast("long").alias("doc_id"), "leak.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES, whole: bool = False) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated, and of those the texts without their hit words.

    With `whole`, rows in which a full window of 13 words occurs go too, however long their texts are. n_chars, where
    there is one, becomes the new length of a text that lost words. Rows with a null text stay; rows with a null or
    repeated doc_id are judged each by its own text.
    """
    found = leaks(docs, benchmark, most_bytes, texts=True).where("not leak.contaminated and not full" if whole else "not leak.contaminated")

    def column(c: str) -> Column:
        kept = F.col(f"row.`{c}`")
        new = {"text": F.col("left"), "n_chars": F.length("left")}.get(c)
        return kept if new is None else F.when(F.col("left").isNotNull(), new.cast(docs.schema[c].dataType)).otherwise(kept).alias(c)

    return found.select(*map(column, docs.columns))
