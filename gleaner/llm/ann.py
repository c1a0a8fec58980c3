"""Approximate nearest neighbours: an NN-descent graph (Dong et al., 2011) and greedy search on it.

Equal vectors are one node, with its least members kept, so a vector that a third of all rows hold is one point. The
graph starts from blocks of random-projection leaves. Each pass samples every node's new and old neighbours in both
directions, joins them at the node (neighbours of neighbours), and sends only pairs nearer than what a side already
has. Vectors travel as they are given, in single precision and unscaled, and every distance is computed in double
precision, so rows of a far larger size change nothing for the others. Search keeps a beam per query, which begins
with the nearest of some pivots; each turn expands all nodes of the beam that are not yet expanded by a join with the
graph, and the search stops when the beam has none left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm._io import spread_join, written

DEGREE, SAMPLE, TREES, LEAF, PASSES, STOP = 24, 14, 4, 192, 8, 0.03
BEAM, PIVOTS, ENTRIES = 256, 64, 12


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<float>): rows that take part, one per vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(v, x -> x <> 0)")
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column(1)
        m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(v), -1) if len(v) else np.zeros((0, 1), np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in m], pa.binary())], ["vec_id", "v"])


def _grouped(work: Callable[[pa.RecordBatch], list], keys: int, names: list[str], types: list, most: int | None = None):
    """Runs `work` on each run of rows with equal leading keys of a sorted stream; a longer run than `most` in parts."""

    def out(rows: list) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
            cut = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0))))
            parts = []
            for a, b in zip(cut, np.concatenate((cut[1:], [batch.num_rows])), strict=True):
                last = b == batch.num_rows
                while most and b - a > most:
                    parts += work(batch.slice(a, most))
                    a += most
                if last:
                    held = batch.slice(a, b - a)
                else:
                    parts += work(batch.slice(a, b - a))
            yield out(parts)
        if held is not None:
            yield out(work(held))

    return run


#: What no distance exceeds, so that all fit single precision.
_FAR = float(np.finfo(np.float32).max)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T
    return np.minimum(np.sqrt(np.maximum(d, 0)), _FAR)


def _leaf(degree: int):
    def work(rows: pa.RecordBatch) -> list:
        ids, m = rows.column(2).to_numpy(zero_copy_only=False), _matrix(rows.column(3), np.float32).astype(np.float64)
        n = len(ids)
        if n < 2:
            return []
        d = _distances(m, m)
        np.fill_diagonal(d, np.inf)
        k = min(degree, n - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        return [(np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel().astype(np.float32))]

    return work


def _meet(rows: pa.RecordBatch) -> list:
    """Pairs among a node's sampled neighbours, at least one of them new, that improve a side's list."""
    ids, new, bound = (rows.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
    _, first = np.unique(ids, return_index=True)  # sorted with the new flag first
    ids, new, bound = ids[first], new[first], bound[first]
    if len(ids) < 2 or not new.any():
        return []
    m = _matrix(rows.column(4), np.float32)[first].astype(np.float64)
    d = _distances(m, m)
    a, b = np.nonzero((new[:, None] | new[None]) & (d < bound[:, None]) & ~np.eye(len(ids), dtype=bool))
    return [(ids[a], ids[b], d[a, b].astype(np.float32))] if len(a) else []


_EDGE = (["u", "b", "d"], [pa.int64(), pa.int64(), pa.float32()])


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u; an edge that is already there keeps its flag."""
    once = edges.groupBy("u", "b").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("d", "b"))).where(F.col("r") <= k).drop("r")


def _leaves(planes: np.ndarray, middle: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), np.float32).astype(np.float64)
            if not len(m):
                continue
            bits = np.einsum("nd,tbd->tnb", m - middle, planes) > 0
            keys = (bits * (1 << np.arange(planes.shape[1]))).sum(axis=2)
            for t in range(len(planes)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(keys[t].astype(np.int64)), batch.column(0), batch.column(1)], ["tree", "key", "id", "v"])

    return run


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE, sample: int = SAMPLE, passes: int = PASSES, seed: int = 17) -> DataFrame:
    """nodes: id, v (packed single-precision vector). Returns edges u, b, d (distance)."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = nodes.count()
    if n < 2:
        return nodes.sparkSession.createDataFrame([], "u long, b long, d float, new boolean")
    dim = len(nodes.select("v").first().v) // 4
    rng = np.random.Generator(np.random.PCG64(seed))
    bits = max(0, math.ceil(math.log2(n / LEAF)))
    planes = rng.normal(size=(TREES if bits else 1, max(bits, 1), dim)).astype(np.float32)
    if not bits:
        planes[:] = 0
    probe = nodes.orderBy(F.xxhash64("id")).limit(512).select("v").collect()
    middle = np.median([np.frombuffer(r.v, np.float32).astype(np.float64) for r in probe], axis=0)
    leaves = nodes.select("id", "v").mapInArrow(_leaves(planes, middle), "tree int, key long, id long, v binary")
    started = leaves.repartition(parts, "tree", "key").sortWithinPartitions("tree", "key", F.xxhash64("id")).mapInArrow(_grouped(_leaf(degree), 2, *_EDGE, most=2 * LEAF), "u long, b long, d float")
    graph = written(_best(started.withColumn("new", F.lit(True)), degree), "ann-graph")
    for turn in range(passes):
        pick = F.xxhash64("u", "b", F.lit(turn))
        top = lambda by: F.row_number().over(Window.partitionBy(by, "new").orderBy(pick))
        placed = written(graph.withColumn("r", top("u")), "ann-sample")
        chosen = placed.where(F.col("r") <= sample).select("u", "b", "new")
        back = chosen.withColumn("r", top("b")).where(F.col("r") <= sample).select(F.col("b").alias("center"), F.col("u").alias("id"), "new")
        bound = graph.groupBy("u").agg(F.max("d").alias("far"), F.count("*").alias("k")).select(F.col("u").alias("id"), F.when(F.col("k") >= degree, F.col("far")).otherwise(F.lit(float("inf"))).cast("float").alias("bound"))
        known = nodes.select("id", "v").join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")).cast("float")))
        members = chosen.select(F.col("u").alias("center"), F.col("b").alias("id"), "new").unionByName(back).groupBy("center", "id").agg(F.max("new").alias("new"))
        met = members.join(known, "id").select("center", "id", "new", "bound", "v")
        found = met.repartition(parts, "center").sortWithinPartitions("center").mapInArrow(_grouped(_meet, 1, *_EDGE), "u long, b long, d float")
        # what was sampled as new is old from now on
        aged = placed.select("u", "b", "d", (F.col("new") & (F.col("r") > sample)).alias("new"))
        graph = written(_best(aged.unionByName(found.withColumn("new", F.lit(True))), degree), "ann-graph")
        fresh = graph.agg(F.sum(F.col("new").cast("long"))).first()[0] or 0
        if fresh <= STOP * n * degree:
            break
    return graph


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (_matrix(batch.column(c), np.float32).astype(np.float64) for c in (2, 3))
        d = np.sqrt(((x - y) ** 2).sum(axis=1)) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["query_id", "id", "d"])


def _entries(ids: np.ndarray, pivots: np.ndarray):
    """Each query's nearest pivots, ENTRIES of them, with their distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), np.float32).astype(np.float64)
            n, k = len(m), min(ENTRIES, len(ids))
            d = np.stack([np.sqrt(((m - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if n else np.zeros((0, len(ids)))
            near = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
            asked = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, k)), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(d, near, 1).ravel())], ["query_id", "id", "d"])

    return run


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """nodes: id, v; graph: u, b, d; queries: query_id, start (its own node, or null), q. Returns the visited (query_id, id, d).

    Both directions of an edge are walked, of the reverse one the nearest DEGREE. Entries are the query's own node, if
    it is indexed, and the nearest of PIVOTS nodes of the least hashes, which every task holds.
    """
    back = graph.select(F.col("b").alias("u"), F.col("u").alias("b"), "d").withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("d", "b"))).where(F.col("r") <= DEGREE).drop("r")
    ways = written(graph.select("u", "b", "d").unionByName(back).select("u", "b").distinct(), "ann-ways")
    pivots = nodes.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()  # PIVOTS at most
    ids, matrix = np.array([r.id for r in pivots], np.int64), np.stack([np.frombuffer(r.v, np.float32) for r in pivots]).astype(np.float64)
    own = queries.where("start is not null").select("query_id", F.col("start").alias("id"), F.lit(0.0).alias("d"))
    entries = queries.select("query_id", "q").mapInArrow(_entries(ids, matrix), "query_id long, id long, d double").join(own.select("query_id", "id"), ["query_id", "id"], "left_anti")
    seen = entries.unionByName(own).withColumn("done", F.lit(False))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    while True:  # each turn expands nodes for good, so it ends
        within = place <= beam
        seen = written(seen.withColumn("_in", within).select("query_id", "id", "d", (F.col("done") | F.col("_in")).alias("done"), (F.col("_in") & ~F.col("done")).alias("now")), "ann-beam")
        front = seen.where("now").select("query_id", F.col("id").alias("u"))
        if front.isEmpty():
            return seen.select("query_id", "id", "d")
        # one aggregation drops what is met twice or was seen; the joins' plans do not turn into others as the table grows
        met = front.join(ways.hint("merge"), "u").select("query_id", F.col("b").alias("id"), F.lit(False).alias("seen")).unionByName(seen.select("query_id", "id", F.lit(True).alias("seen")))
        reached = met.groupBy("query_id", "id").agg(F.bool_or("seen").alias("seen")).where("not seen").select("query_id", "id")
        pairs = reached.join(nodes.select("id", "v").hint("merge"), "id").join(queries.select("query_id", "q"), "query_id").select("query_id", "id", "q", "v")
        new = pairs.mapInArrow(_exact, "query_id long, id long, d double").withColumn("done", F.lit(False))
        seen = seen.drop("now").unionByName(new)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each row whose vec_id is divisible by `every`.

    vectors: vec_id, embedding; other columns are ignored, whatever their names. Nulls, zero vectors and vectors with null
    or non-finite components take no part; vectors of different lengths have no distance, so those of each length are
    searched by themselves. A repeated vec_id counts once, with its least vector. Ties go to the smaller vec_id.
    """
    rows = usable(vectors)
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in sorted(r.n for r in rows.select(F.size("v").alias("n")).distinct().collect()):  # one, in a sound table
        found = found.unionByName(_nearest(rows.where(F.size("v") == length), every, k))
    return found


def _nearest(rows: DataFrame, every: int, k: int) -> DataFrame:
    """nearest() of rows (vec_id, v) of one length."""
    rows = written(rows.mapInArrow(_packed, "vec_id long, v binary"), "ann-vectors")
    nodes = written(rows.groupBy("v").agg(F.min("vec_id").alias("id")).select("id", "v"), "ann-nodes")
    of = Window.partitionBy("v").orderBy("vec_id")
    least = rows.select("v", "vec_id").withColumn("r", F.row_number().over(of)).where(F.col("r") <= k + 1)
    members = written(least.join(nodes.select("id", "v"), "v").select("id", "vec_id"), "ann-members")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = written(asked.join(nodes.select(F.col("v").alias("q"), F.col("id").alias("start")), "q").select("query_id", "start", "q"), "ann-queries")
    graph = neighbour_graph(nodes)
    found = search(nodes, graph, asked)
    rank = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy("d", by))
    top = found.withColumn("r", rank("id")).where(F.col("r") <= k + 1).select("query_id", "id", "d")
    out = spread_join(written(top, "ann-top"), members, ["id"]).where("vec_id <> query_id").withColumn("rank", rank("vec_id")).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))
