"""Exact removal of repeated byte strings: a depth-limited radix sort of suffixes, from sparse anchors.

A byte is removed when a string of `length` bytes that covers it also starts anywhere else in the corpus. Sorting all
suffixes to that depth would shuffle every byte position; only suffixes at *anchors* are sorted here. Each window of
`length` bytes holds `w = length - k + 1` k-grams; its anchor is the k-gram with the least hash, the leftmost of equal
ones. The choice depends on the window's content alone, so equal windows have equal anchors at equal offsets, and
windows only need comparing where their anchors are equal. Passes, most significant digit first:

1. digit 1 is the anchor's k-gram: anchors whose k-gram occurs once drop out (the bulk of a corpus), and of contexts
   (all that windows with that anchor can hold) that are equal one goes on: the others repeat with all their windows;
2. a bucket with up to `group` distinct contexts is split by the full window, offset by offset, in one task. Windows
   with equal hashes are compared byte by byte: equal groups are exactly the repeated windows;
3. a larger bucket is never brought together: its contexts are cut into blocks of window offsets, whose next digit is
   what all windows of a block hold in common, and go through step 2 again, with blocks a quarter as wide each time. A
   block of one offset is a full window.

Equal contexts and blocks are combined within each map task before any shuffle, so a text that fills a third of the
corpus sends a row per task; buckets are then read as sorted streams, never collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._io import discarded, hot_keys, spread_join, unique_rows, written
from gleaner.llm._text import _CODES, U64, mix, prefix, ragged, signed, slices, spans_hash, text_buffers, window_min

LENGTH = 200
#: Bytes of the first digit.
GRAM = 64
#: Distinct contexts of one bucket that a task splits by window itself.
GROUP = 1024
#: Bytes of text that anchors are found in at once; longer texts are taken whole.
SLICE = 1 << 18
#: Occurrences of a k-gram in one batch that are counted towards the frequent ones.
SEEN = 8
#: Offsets of a bucket's blocks in each further pass.
BLOCKS = (64, 16, 4, 1)

_ANCHORS = "key long, at int, lo int, hi int, gram long, context long, many boolean, seen int"
_FOUND = "kind byte, key long, lo int, hi int, at int, gram long, many boolean"
_AROUND = "kind byte, key long, lo int, hi int, at int, part long, many boolean, bytes binary"


def _shape(length: int) -> tuple[int, int]:
    k = min(GRAM, max(1, length // 2))
    return k, length - k + 1


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first and last window start, k-gram hash, context hash) of each anchor of some texts."""
    k, w = _shape(length)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(U64), none.astype(U64)
    pre, other = prefix(data, _CODES[0]), prefix(data, _CODES[1], 1)
    at = np.arange(len(data) - k + 1)
    grams = mix(spans_hash(pre, at, at + k))
    least = window_min((grams & U64(0xFFFFFFFF00000000)) | at.astype(U64), w)
    pick = (least & U64(0xFFFFFFFF)).astype(np.int64)
    p = np.arange(len(pick))
    text = np.searchsorted(ends, p, side="right")
    whole = p + length <= ends[np.minimum(text, len(ends) - 1)]
    p, pick, text = p[whole], pick[whole], text[whole]
    if not len(p):
        return none, none, none, none, none.astype(U64), none.astype(U64)
    run = np.flatnonzero(np.concatenate(([True], (pick[1:] != pick[:-1]) | (text[1:] != text[:-1]))))
    a, lo, hi, t = pick[run], p[run], p[np.concatenate((run[1:], [len(p)])) - 1], text[run]
    left, right = np.minimum(a - starts[t], w - 1), np.minimum(ends[t] - a, length)
    context = mix(spans_hash(other, a - left, a + right, 1) + left.astype(U64) * U64(1_000_003) + right.astype(U64))
    return t, a - starts[t], lo - starts[t], hi - starts[t], grams[a], context


def _combined(ids: np.ndarray, found: list[tuple[np.ndarray, ...]], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of some texts' anchors; of equal contexts one row goes on and the others, known to repeat, are spans."""
    text, at, lo, hi, gram, context = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(text):
        return
    order = np.lexsort((context, gram))
    text, at, lo, hi, gram, context = (x[order] for x in (text, at, lo, hi, gram, context))
    first = np.concatenate(([True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])))
    size = np.diff(np.concatenate((np.flatnonzero(first), [len(first)])))
    many = size > 1
    g = gram[first]
    new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    seen = np.zeros(len(g), np.int64)
    seen[new] = np.diff(np.concatenate((new, [len(g)])))
    yield _batch(ids[text[first]], at[first], lo[first], hi[first], g, context[first], many, np.where(seen >= SEEN, seen, 0))
    if (~first).any():
        # known to repeat: a group of its own, so that a common text's spans are spread over all tasks
        rest = ~first
        own = mix(ids[text[rest]].astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + at[rest].astype(U64)) ^ gram[rest]
        yield _batch(ids[text[rest]], at[rest], lo[rest], hi[rest], own, own, np.ones(len(own), bool), np.zeros(len(own), np.int64))


def _batch(doc, at, lo, hi, gram, context, many, seen) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (at, lo, hi)), pa.array(signed(gram)), pa.array(signed(context)), pa.array(many), pa.array(seen.astype(np.int32))],
        ["key", "at", "lo", "hi", "gram", "context", "many", "seen"],
    )


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held: list[tuple[np.ndarray, ...]] = []
            count = 0
            for i, _, data, starts, ends in slices(batch.column(1), SLICE):
                t, *rest = anchors(data, starts, ends, length)
                held.append((t + i, *rest))
                count += len(t)
                if count > 200_000:
                    yield from _combined(ids, held, length)
                    held, count = [], 0
            if held:
                yield from _combined(ids, held, length)

    return run


def _split_anchors(length: int):
    """Over rows sorted by (gram, context): spans of equal contexts, and one representative per context of each k-gram
    that has several. Carries a single row from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the open group's representative: columns, then: span told, k-gram has several contexts
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(7)]
            cols += [np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)]
            if kept is not None:
                cols = [np.concatenate(([k], c)) for k, c in zip(kept, cols, strict=True)]
            out, kept = _step(cols, last=False)
            yield from out
        if kept is not None:
            out, _ = _step([np.array([k]) for k in kept], last=True)
            yield from out

    return run


def _step(cols: list[np.ndarray], last: bool) -> tuple[list[pa.RecordBatch], list | None]:
    doc, at, lo, hi, gram, context, many, told, several = cols
    n = len(doc)
    new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
    first = new_gram | np.concatenate(([True], context[1:] != context[:-1]))
    cls, kid = np.cumsum(first) - 1, np.cumsum(new_gram) - 1
    heads = np.flatnonzero(first)
    size = np.bincount(cls)
    repeats = (size > 1) | np.bincount(cls, weights=many) .astype(bool)
    classes = np.bincount(kid[heads])
    multi = (classes > 1) | (np.bincount(kid, weights=several) > 0)
    spans = repeats[cls] & ~told
    reps = multi[kid[heads]].copy()
    if not last:
        reps[-1] = False
    out = []
    if spans.any():
        out.append(_found(0, doc[spans], lo[spans], hi[spans], at[spans], gram[spans], np.ones(int(spans.sum()), bool)))
    if reps.any():
        h = heads[reps]
        out.append(_found(1, doc[h], lo[h], hi[h], at[h], gram[h], repeats[reps]))
    if last:
        return out, None
    h = heads[-1]
    kept = [doc[h], at[h], lo[h], hi[h], gram[h], context[h], bool(repeats[-1]), bool(repeats[-1]), bool(multi[-1])]
    return out, kept


def _found(kind: int, doc, lo, hi, at, gram, many) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind, np.int8)), pa.array(doc, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (lo, hi, at)), pa.array(gram.astype(np.int64)), pa.array(many.astype(bool))],
        ["kind", "key", "lo", "hi", "at", "gram", "many"],
    )


def _contexts(length: int):
    """The bytes around each remaining anchor, from the texts of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = text_buffers(batch.column(1))
            items = batch.column(2)
            if not batch.num_rows:
                continue
            off = items.offsets.to_numpy()
            flat = items.values.slice(off[0], off[-1] - off[0])
            lo, hi, at, gram, many = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "at", "gram", "many"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(off))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(row), 20_000):
                r = slice(i, i + 20_000)
                base = starts[row[r]]
                text = [data[x:y].tobytes() for x, y in zip((base + lo[r]).tolist(), (base + hi[r] + length).tolist(), strict=True)]
                yield _around(1, ids[row[r]], lo[r], hi[r], at[r], gram[r], many[r], text)

    return run


def _around(kind: int, key, lo, hi, at, part, many, text) -> pa.RecordBatch:
    """Kind 0: windows lo..hi of key repeat. Kind 1: they are to be compared with others of their part."""
    n = len(key)
    cols = [pa.array(np.full(n, kind, np.int8)), pa.array(key, pa.int64()), *(pa.array(np.asarray(x).astype(np.int32)) for x in (lo, hi, at))]
    rest = [pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in ((part, pa.int64()), (many, pa.bool_()), (text, pa.binary()))]
    return pa.RecordBatch.from_arrays([*cols, *rest], ["kind", "key", "lo", "hi", "at", "part", "many", "bytes"])


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, each one's first, its size)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes


def _windows(length: int):
    """Over contexts sorted by part: within a part, windows at equal offsets of the anchor that are equal."""

    def compared(rows: list) -> Iterator[pa.RecordBatch]:
        data, first, sizes = _joined([r[5] for r in rows])
        low, at = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
        told = np.array([r[4] for r in rows], bool)
        counts = sizes - length + 1
        pre = prefix(data, _CODES[1], 1)
        i = ragged(counts)
        row = np.repeat(np.arange(len(rows)), counts)
        p = first[row] + i
        offset = (at - low)[row] - i
        h = mix(spans_hash(pre, p, p + length, 1) + offset.astype(U64) * U64(0x9E3779B1))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        # equal hashes are candidates; bytes and offsets decide
        x, y = order[:-1][same], order[1:][same]
        view = np.lib.stride_tricks.sliding_window_view(data, length)
        equal = np.zeros(len(x), bool)
        for j in range(0, len(x), 8192):
            s = slice(j, j + 8192)
            equal[s] = (offset[x[s]] == offset[y[s]]) & (view[p[x[s]]] == view[p[y[s]]]).all(axis=1)
        hit = np.zeros(len(h), bool)
        hit[x[equal]] = hit[y[equal]] = True
        hit &= ~told[row]
        if hit.any():
            row, start = row[hit], (low[row] + i)[hit]
            run = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))
            b = np.flatnonzero(run)
            e = np.concatenate((b[1:], [len(row)])) - 1
            yield _around(0, np.array([r[0] for r in rows])[row[b]], start[b], start[e], start[b], None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []  # of the open part
        part = None
        pending: list = []  # of whole parts, done together: a window holds its own part at the same offset

        def close() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1 and not all(r[4] for r in rows):
                pending.extend(rows)
                if len(pending) > GROUP:
                    yield from compared(pending)
                    pending.clear()
            rows.clear()

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(7)]
            for key, lo, hi, at, g, many, text in zip(*cols, strict=True):
                if g != part:
                    yield from close()
                    part = g
                rows.append((key, lo, hi, at, many, text))
        yield from close()
        if pending:
            yield from compared(pending)

    return run


def _blocks(length: int, size: int):
    """Contexts of crowded parts, cut into blocks of `size` window offsets: the next part is what a block's windows share.

    Of equal blocks in a batch one goes on, as known to repeat; its span and the others' are told.
    """
    most = _shape(length)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lo, hi, at, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3, 5))
            texts = batch.column(6).to_pylist()
            data, first, _ = _joined(texts)
            low, high = (at - hi) // size, (at - lo) // size
            row = np.repeat(np.arange(len(key)), high - low + 1)
            block = low[row] + ragged(high - low + 1)
            o1 = block * size
            b_lo, b_hi = np.maximum(lo[row], at[row] - o1 - size + 1), np.minimum(hi[row], at[row] - o1)
            base = first[row] - lo[row]
            pre, other = prefix(data, _CODES[0]), prefix(data, _CODES[1], 1)
            x, y = base + at[row] - o1, base + at[row] - np.minimum(o1 + size, most) + 1 + length
            part = mix(spans_hash(pre, x, y) + o1.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(size))
            x, y = base + b_lo, base + b_hi + length
            whole = mix(spans_hash(other, x, y, 1) + (at[row] - b_lo).astype(U64) * U64(1_000_003) + (at[row] - b_hi).astype(U64))
            order = np.lexsort((~many[row], whole, part))  # of equal ones one already told comes first
            new = np.concatenate(([True], (part[order][1:] != part[order][:-1]) | (whole[order][1:] != whole[order][:-1])))
            at_new = np.flatnonzero(new)
            count = np.diff(np.concatenate((at_new, [len(order)])))
            repeats = np.repeat(count > 1, count) | np.repeat(many[row][order][at_new], count)
            tell = order[repeats & ~many[row][order]]
            if len(tell):
                yield _around(0, key[row[tell]], b_lo[tell], b_hi[tell], at[row[tell]], None, None, None)
            go = order[at_new]
            yield _around(1, key[row[go]], b_lo[go], b_hi[go], at[row[go]], signed(part[go]), repeats[at_new], [data[a:b].tobytes() for a, b in zip(x[go].tolist(), y[go].tolist(), strict=True)])

    return run


def _remove(length: int, texts: bool):
    """Merges a document's repeated windows, and what is left without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = text_buffers(batch.column(1))
            items = batch.column(2)
            valid = np.asarray(items.is_valid())
            off = items.offsets.to_numpy() if len(items) else np.zeros(1, np.int64)
            lo_all, hi_all = (items.values.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            cols: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                body = data[starts[i] : ends[i]]
                removed = spans = 0
                if valid[i] and off[i + 1] > off[i]:
                    lo, hi = lo_all[off[i] : off[i + 1]].astype(np.int64), hi_all[off[i] : off[i + 1]].astype(np.int64) + length
                    order = np.argsort(lo, kind="stable")
                    lo, reach = lo[order], np.maximum.accumulate(hi[order])
                    b = np.flatnonzero(np.concatenate(([True], lo[1:] > reach[:-1])))
                    b_lo, b_hi = lo[b], reach[np.concatenate((b[1:], [len(lo)])) - 1]
                    removed, spans = int((b_hi - b_lo).sum()), len(b)
                    raw = body.tobytes()
                    cut, parts = 0, []
                    for x, y in zip(b_lo.tolist(), b_hi.tolist(), strict=True):
                        parts.append(raw[cut:x])
                        cut = y
                    left = b"".join([*parts, raw[cut:]])
                else:
                    left = body.tobytes()
                for c, v in zip(cols, (len(body), removed, spans, hashlib.sha256(left).hexdigest(), left if texts else None), strict=True):
                    c.append(v)
            out = [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(cols[4], pa.binary())] if texts else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP, texts: bool = False) -> DataFrame:
    """Of each document its size, the bytes that repeated windows of `length` bytes cover, and the digest of the rest.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and with
    texts=True the remaining bytes as `kept`, a row for every row of docs. A null text counts as empty; a text shorter
    than `length` keeps all its bytes; copies, also within a document, all lose what repeats (there is no first one
    that stays). Rows with a null doc_id, or with one that other rows have too, are documents like others: equal rows
    lose what they share.
    """
    rows = unique_rows(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchored = written(rows.select("key", "text").mapInArrow(_anchor_rows(length), _ANCHORS), "substring-anchors")
    frequent = hot_keys(anchored.where("seen > 0").groupBy("gram").agg(F.sum("seen").alias("n")), ["gram"], group)
    kept = anchored.drop("seen")
    rare = kept if frequent is None else kept.join(F.broadcast(frequent), "gram", "left_anti").select(*kept.columns)
    found = rare.repartition(parts, "gram").sortWithinPartitions("gram", "context").mapInArrow(_split_anchors(length), _FOUND)
    if frequent is not None:  # buckets that no task may hold: all their contexts go on, those known to repeat are told
        crowd = kept.join(F.broadcast(frequent), "gram", "left_semi")
        kinds = F.when(F.col("many"), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1))).cast("array<byte>")
        found = found.unionByName(crowd.select(F.explode(kinds).alias("kind"), "key", "lo", "hi", "at", "gram", "many"))
    found = written(found, "substring-found")
    discarded(anchored)
    open_ = found.where("kind = 1").groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "at", "gram", "many")).alias("items"))
    around = state = written(rows.select("key", "text").join(open_, "key").select("key", "text", "items").mapInArrow(_contexts(length), _AROUND), "substring-around")
    spans = found.where("kind = 0").select("key", "lo", "hi")
    columns = ["key", "lo", "hi", "at", "part", "many", "bytes"]
    for size in BLOCKS:
        open_ = state.where("kind = 1").select(*columns)
        crowded = hot_keys(open_.groupBy("part").agg(F.count("*").alias("n")), ["part"], group)
        few = open_ if crowded is None else open_.join(F.broadcast(crowded), "part", "left_anti").select(*columns)
        told = few.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_windows(length), _AROUND)
        told = written(told.select("key", "lo", "hi"), "substring-windows")
        spans = spans.unionByName(told)
        if crowded is None:
            break
        state = written(open_.join(F.broadcast(crowded), "part", "left_semi").select(*columns).mapInArrow(_blocks(length, size), _AROUND), "substring-blocks")
        spans = spans.unionByName(state.where("kind = 0").select("key", "lo", "hi"))
    else:  # parts are full windows now: a part of several rows repeats, however many
        last = state.where("kind = 1 and not many").select("key", "lo", "hi", "part", "bytes")
        repeated = state.where("kind = 1").groupBy("part", "bytes").agg(F.count("*").alias("n")).where("n > 1").select("part", "bytes")
        spans = spans.unionByName(spread_join(last, repeated, ["part", "bytes"], "left_semi").select("key", "lo", "hi"))
    discarded(around)
    merged = spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return rows.join(merged, "key", "left").select("doc_id", "text", "spans").mapInArrow(_remove(length, texts), out)
