"""Ranking documents for queries: a cheap cut by vectors, then a finer scorer on what is left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.vectors import cosine, text_words
from gleaner.storage import stored

#: Documents per query that the cut leaves for the scorer, and ranks that are returned.
PREFILTER, TOP = 200, 10
#: Numbers of queries' vectors that a task holds at once (16 MB); more queries go in more blocks.
MOST_NUMBERS = 1 << 21


def overlap(a: Column, b: Column) -> Column:
    """Words two texts share, over all their words, without case: the offline stand-in for a cross-encoder."""
    x, y = F.array_distinct(text_words(F.lower(a))), F.array_distinct(text_words(F.lower(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def _ranked(rows: DataFrame, score: str, most: int | None) -> DataFrame:
    """Adds rank within a query by score, ties by place. Spark cuts each task's rows to `most` before they move."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("doc_pos"))))
    return ranked.where(F.col("rank") <= most) if most else ranked


def _products(block: np.ndarray, ids: pa.Array, most: int | None):
    """Of each batch of (doc_pos, vector) the `most` greatest products with each query's vector, ties at the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            rows = np.flatnonzero(np.asarray(vectors.is_valid()) & (pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False) == block.shape[1]))
            if not len(rows):
                continue
            kept = vectors.take(pa.array(rows))
            matrix = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
            for q in range(0, len(block), 512):
                scores = block[q : q + 512] @ matrix.T
                scores[np.isnan(scores)] = -np.inf
                if most and most < len(rows):
                    least = np.partition(scores, len(rows) - most, axis=1)[:, len(rows) - most]
                    at, doc = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                else:
                    at, doc = np.nonzero(scores > -np.inf)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + q)), batch.column(0).take(pa.array(rows[doc])), pa.array(scores[at, doc])], ["query_id", "doc_pos", "score"])

    return run


def nearest_by_vector(queries: DataFrame, documents: DataFrame, most: int | None = PREFILTER) -> DataFrame:
    """query_id, doc_pos, score, rank: per query its documents of the greatest product of vectors, ties to the lesser place.

    queries: query_id, query_vector (a stated set); documents: doc_pos, vector. Queries go to tasks as matrices of
    bounded size, block by block; each task multiplies them with its documents' and keeps `most` a query before any row
    moves. Rows whose vector is null or of another length than a block's queries take no part with it, nor do products that are not a number.
    """
    asked = stored(queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")).where("v is not null and size(v) > 0"), "ranking-queries")
    spark, schema = queries.sparkSession, T.StructType([asked.schema["query_id"], documents.schema["doc_pos"], T.StructField("score", T.DoubleType())])
    docs = documents.select("doc_pos", F.col("vector").cast("array<double>").alias("vector"))
    out = spark.createDataFrame([], schema)
    for size, n in sorted(tuple(r) for r in asked.groupBy(F.size("v")).count().collect()):  # a row per length of vectors
        blocks = -(-n * size // MOST_NUMBERS)
        for block in range(blocks):
            held = asked.where((F.size("v") == size) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()  # about MOST_NUMBERS numbers
            vectors = held.column("v").combine_chunks()
            matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), size)
            out = out.unionByName(docs.mapInArrow(_products(matrix, held.column("query_id").combine_chunks(), most), schema))
    return _ranked(out, "score", most)


def two_stage(queries: DataFrame, documents: DataFrame, scorer: Callable[[Column, Column], Column] = overlap, prefilter: int = PREFILTER, top: int | None = TOP) -> DataFrame:
    """query_id, query, doc_pos, text, score, rank. Queries with the same text count once, under the least id.

    queries: query_id, query, query_vector; documents: doc_pos, text, vector. The scorer sees prefilter rows a query.
    """
    once = stored(queries.groupBy("query").agg(F.min_by(F.struct("query_id", "query_vector"), "query_id").alias("q")).select("q.query_id", "query", "q.query_vector"), "ranking-once")
    # a row is a query and a place until the cut is made; then it gets its texts
    near = stored(nearest_by_vector(once, documents, prefilter).select("query_id", "doc_pos"), "ranking-near")
    rows = documents.select("doc_pos", "text").join(near, "doc_pos").join(once.select("query_id", "query"), "query_id")
    return _ranked(rows.withColumn("score", scorer(F.col("query"), F.col("text"))), "score", top).select("query_id", "query", "doc_pos", "text", "score", "rank")


def pair_similarity(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The cosine of vectors of rows that share keys."""
    return left.join(right.withColumnRenamed("vector", "other"), on).withColumn("similarity", cosine(F.col("vector"), F.col("other"))).drop("other")
