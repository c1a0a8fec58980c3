"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

Two permutations give the whole signature: sigma scatters a shingle over a universe of 2**20 places, pi ranks the
places, and coordinate k is the least rank among pi shifted circularly by k (C-MinHash-(sigma, pi), Li and Li, 2022).
The ranks that a shingle adds to all coordinates are then one contiguous stretch of pi, read once.

Documents with equal shingle sets are one class before anything is compared. Candidates are classes that share a band.
Within a bucket each member is first compared with the least member alone; most buckets are then one component. The
others' members form groups that are connected by shared buckets. In each group the members outside its largest
component are compared, in blocks of bounded size, with the members of other components: sketches of the signatures
screen out pairs whose estimate is five standard errors under the threshold, the full sets decide, and a block returns
only links that join two components it had not joined yet. So no bucket is ever expanded into pairs of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _io
from gleaner.llm._graph import components
from gleaner.llm._io import dealt_join, own_ids, spread_join, unique_rows, written
from gleaner.llm._text import SPACE_WORDS, U64, Words, mix, signed, slices

SHINGLE = 5
BANDS, ROWS = 32, 5
UNIVERSE = 1 << 20
#: Bytes of members, and of members outside the largest component, that are compared at once.
BLOCK = 2 << 20
#: The screen passes estimates down to this much under the threshold: five standard errors of 160 coordinates.
SLACK = 0.15

_tables: list[np.ndarray] = []


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        rng = np.random.Generator(np.random.PCG64(71))
        sigma = rng.permutation(UNIVERSE).astype(np.int32)
        pi = rng.permutation(UNIVERSE).astype(np.uint32)
        _tables.extend((sigma, np.concatenate((pi, pi[: BANDS * ROWS]))))
    return _tables[0], _tables[1]


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a set of shingle hashes."""
    sigma, pi = _permutations()
    width = BANDS * ROWS
    stretch = np.lib.stride_tricks.sliding_window_view(pi, width)
    places = sigma[(shingles & U64(UNIVERSE - 1)).astype(np.int64)]
    out = np.full(width, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 512):
        np.minimum(out, stretch[places[i : i + 512]].min(axis=0), out=out)
    return out


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j, data, starts, ends in slices(column):
        words = Words(data, starts, ends, SPACE_WORDS)
        at, grams = words.grams(k)
        cut = np.searchsorted(at, words.ptr)
        for r in range(j - i):
            n = words.count[r]
            if n >= k:
                yield np.unique(grams[cut[r] : cut[r + 1]])
            elif n:
                yield _short(words.hash[words.ptr[r] : words.ptr[r + 1]])
            else:
                yield np.zeros(0, U64)


def _short(hashes: np.ndarray) -> np.ndarray:
    g = np.zeros(1, U64)
    for h in hashes:
        g = g * U64(0x9FB21C651E98DF25) + h
    return mix(g + np.array([len(hashes)], U64) * U64(0xA0761D6478BD642F))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = np.array([pow(0x9E3779B97F4A7C15, r + 1, 1 << 64) for r in range(ROWS)], U64)
    salt = mix(np.arange(1, BANDS + 1).astype(U64))
    for batch in batches:
        n = batch.num_rows
        size, s1, s2 = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
        bands = np.zeros((n, BANDS), U64)
        sketch = np.zeros((n, BANDS * ROWS), np.uint8)
        for i, s in enumerate(shingle_sets(batch.column(1))):
            size[i] = len(s)
            if len(s):
                s1[i], s2[i] = s.sum(dtype=U64), mix(s + U64(0x1234567)).sum(dtype=U64)
                sig = signature(s)
                bands[i] = mix((sig.reshape(BANDS, ROWS).astype(U64) * weights).sum(axis=1, dtype=U64) ^ salt)
                sketch[i] = (sig * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(signed(bands.ravel())))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(size), pa.array(signed(s1)), pa.array(signed(s2)), lists, pa.array([x.tobytes() for x in sketch], pa.binary())],
            ["key", "n_shingles", "s1", "s2", "bands", "sketch"],
        )


def _verify(percent: int):
    """Pairs of texts whose shingle sets meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_meets(x, y, percent) for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _meets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets meet the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    i = np.minimum(np.searchsorted(b, a), len(b) - 1)
    inter = int((b[i] == a).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def _joining(percent: int):
    """Over rows sorted by block: links between members of different components, as many as join them."""
    least = percent / 100 - SLACK
    width = BANDS * ROWS

    def block(rows: pa.RecordBatch) -> list[tuple[int, int]]:
        ids, comp, size, outer = (rows.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5, 6))
        sketch = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint8).reshape(-1, width)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        sets: list[np.ndarray] | None = None
        found = []
        inner = np.flatnonzero(~outer)
        for i in np.flatnonzero(outer):
            near = inner[(comp[inner] != comp[i]) & (100 * np.minimum(size[inner], size[i]) >= percent * np.maximum(size[inner], size[i]))]
            if not len(near):
                continue
            same = (sketch[near] == sketch[i]).sum(axis=1) / width
            for j in near[(same - 1 / 256) / (1 - 1 / 256) >= least]:
                x, y = root(comp[i]), root(comp[j])
                if x == y:
                    continue
                if sets is None:
                    sets = list(shingle_sets(rows.column(8)))
                if _meets(sets[i], sets[j], percent):
                    up[max(x, y)] = min(x, y)
                    found.append((ids[i], ids[j]))
        return found

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        got = np.array([x for r in rows for x in block(r)], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            cut = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
            held = batch.slice(cut[-1])
            if len(cut) > 1:
                yield links([batch.slice(x, y - x) for x, y in zip(cut[:-1], cut[1:], strict=True)])
        if held is not None:
            yield links([held])

    return run


def _components(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """rows: key (unique), text. Returns key, n_shingles, component: the least key reachable."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "key long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"
    sketched = written(rows.select("key", "text").mapInArrow(_signatures, schema), "neardup-signatures")
    classes = sketched.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("key").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes, "neardup-classes")

    banded = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    buckets = written(banded.groupBy("band", "bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("m")).where("m > 1"), "neardup-buckets")
    place = ["band", "bucket"]
    most = max(_io.FREQUENT, (buckets.agg(F.sum("m")).first()[0] or 0) // 100_000)
    crowded = buckets.where(F.col("m") > most).select(*place, F.ceil(F.col("m") / most).cast("int").alias("_parts"))
    crowded = None if crowded.isEmpty() else crowded
    members = written(dealt_join(banded, buckets, place, crowded).select(*place, "leader", "rep"), "neardup-members")
    # texts of all that share a bucket, moved once; a plan that does not turn into another one as the corpus grows
    texts = written(rows.select("key", "text").join(members.select(F.col("rep").alias("key")).distinct().hint("merge"), "key", "left_semi"), "neardup-texts")
    tried = written(members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "neardup-tried")
    links = verified(tried, texts, percent)
    label = components(links)

    # what leaders alone have not settled
    placed = written(members.join(label.withColumnRenamed("id", "rep"), "rep", "left").select(*place, "leader", "rep", F.coalesce("component", "rep").alias("comp")), "neardup-placed")
    open_buckets = placed.groupBy(*place).agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select(*place)
    open_ = written(dealt_join(placed, open_buckets, place, crowded, "left_semi").select("leader", "rep", "comp").distinct(), "neardup-open")
    groups = components(open_.select(F.col("leader").alias("a"), F.col("rep").alias("b"))).select(F.col("id").alias("rep"), F.col("component").alias("group"))
    grouped = open_.select("rep", "comp").distinct().join(groups, "rep").join(texts.select(F.col("key").alias("rep"), F.octet_length("text").alias("bytes")), "rep")
    grouped = written(grouped, "neardup-grouped")
    counts = grouped.groupBy("group", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    split = (
        counts.groupBy("group").agg(F.max(F.struct("bytes", "n", "comp")).alias("top"), F.sum("n").alias("m"), F.sum("bytes").alias("all"))
        .select("group", F.col("top.comp").alias("main"), _shares(F.col("m") - F.col("top.n"), F.col("all") - F.col("top.bytes"), block).alias("outers"), _shares(F.col("m"), F.col("all"), block).alias("inners"))
    )
    placed = spread_join(grouped, split, ["group"])
    rows_ = placed.join(classes.select("rep", "n_shingles", "sketch"), "rep").join(texts.select(F.col("key").alias("rep"), "text"), "rep")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["rep", "comp", "n_shingles"]
    inside = rows_.where("outers > 0").select("group", own("inners").alias("inner_block"), spread("outers").alias("outer_block"), *rest, F.lit(False).alias("is_outer"), "sketch", "text")
    outside = rows_.where("comp <> main").select("group", spread("inners").alias("inner_block"), own("outers").alias("outer_block"), *rest, F.lit(True).alias("is_outer"), "sketch", "text")
    keys = ["group", "inner_block", "outer_block"]
    more = written(inside.unionByName(outside).repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_joining(percent), "a long, b long"), "neardup-links")

    of = label.withColumnRenamed("id", "node")
    merged = more.join(of.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("component", "a").alias("a"), "b")
    merged = merged.join(of.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("component", "b").alias("b"))
    top = components(merged).select(F.col("id").alias("component"), F.col("component").alias("final"))
    reps = classes.select("rep", "s1", "s2", "n_shingles").join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    reps = spread_join(written(reps, "neardup-reps"), top, ["component"], "left").select("s1", "s2", "n_shingles", F.coalesce("final", "component").alias("final"))
    out = spread_join(sketched.select("key", "n_shingles", "s1", "s2"), reps, ["s1", "s2", "n_shingles"], "left")
    return out.select("key", "n_shingles", F.coalesce("final", "key").alias("component"))


def _shares(n: Column, size: Column, block: int) -> Column:
    """Blocks of about `block` bytes that n members of `size` bytes are dealt to, one member in each at the least."""
    return F.least(n, F.ceil(size / block)).cast("int")


def near_duplicates(docs: DataFrame, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """Each document's component of documents linked by a Jaccard similarity of shingle sets of percent/100 or more.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_shingles, component_id (the least doc_id reachable),
    kept (doc_id = component_id), a row for every row of docs. Null or blank texts have no shingles and are linked with
    nothing; texts under five words are one shingle. Rows with the same doc_id are documents like others: equal texts
    are in one component, others need not be. A null doc_id comes after all others; of a component of null ids alone
    the id is null and one row is kept.
    """
    own = own_ids(docs)
    rows = unique_rows(docs, own=own)
    found = _components(rows, percent, block)
    if own:
        out = found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
        return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    found = found.join(rows.select("key", "doc_id"), "key")
    found = spread_join(written(found, "neardup-found"), rows.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id")), ["component"])
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("key") == F.col("component"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """The rows of docs, with all their columns: of each component of near_duplicates() the first one alone.

    The first one has the least doc_id, nulls last; of rows with the same doc_id one stays if their texts are linked, and
    all do if they are not. Rows without shingles all stay.
    """
    rows = unique_rows(docs, whole=True)
    gone = _components(rows, percent, block).where("key <> component").select("key")
    return rows.join(gone.hint("merge"), "key", "left_anti").select("row.*")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b) whose full sets meet the threshold."""
    rows = spread_join(pairs, texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), ["a"]).join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    return written(rows.select("a", "b", "ta", "tb").mapInArrow(_verify(percent), "a long, b long"), "neardup-links")
