"""Topics of documents: weighted terms, clusters of them, and their ten strongest terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.vectors import let, stop_words
from gleaner.storage import dealt, stored

# What counts as a word, and parameters of terms and clusters.
WORD = r"[\p{L}\p{N}_]{2,}"
MAX_SHARE, MIN_DOCUMENTS, TOPICS, SEED, TERMS = 0.8, 5, 10, 42, 10
#: Terms that a model holds at most, the most frequent first; documents are not limited.
VOCABULARY = 1 << 18
#: Words that are counted together: documents, and words and pairs by their numbers, then fit into 64 bits.
WORDS_AT_ONCE = 1 << 20
#: Documents of a task: a file's row group, which one task reads, can hold far more; of fewer, more terms would move.
DOCUMENTS = 1 << 13


def content_words(text: Column) -> Column:
    """Lower-cased words of two letters or more, in order, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*stop_words()))


def terms(text: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pair = lambda ws: F.transform(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.element_at(ws, i + 1), w))
    return let(content_words(text), lambda ws: F.concat(ws, pair(ws)))


def _counted(words: pa.ListArray) -> pa.RecordBatch:
    """term, documents, occurrences within some documents, given by their words. A word or pair is a number until it is counted."""
    coded = words.flatten().dictionary_encode()
    code, known, k = coded.indices.to_numpy().astype("int64"), coded.dictionary, max(1, len(coded.dictionary))
    doc = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    near = np.flatnonzero(doc[1:] == doc[:-1])
    key, of = np.concatenate([code, k + code[near] * k + code[near + 1]]), np.concatenate([doc, doc[near]])
    once, n = np.unique(of * (k + k * k) + key, return_counts=True)  # each document's terms
    key, place, documents = np.unique(once % (k + k * k), return_inverse=True, return_counts=True)
    occurrences = np.bincount(place, weights=n, minlength=len(key)).astype("int64")
    single, pair = known.take(pa.array(key[key < k])), key[key >= k] - k
    pairs = pc.binary_join_element_wise(known.take(pa.array(pair // k)), known.take(pa.array(pair % k)), " ")
    return pa.RecordBatch.from_arrays([pa.concat_arrays([single, pairs]), pa.array(documents.astype("int64")), pa.array(occurrences)], names=["term", "documents", "occurrences"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of runs of documents with WORDS_AT_ONCE words at most, or of one document that has more."""
    for batch in batches:
        words, at = batch.column(0), 0
        ends = words.offsets.to_numpy().astype("int64")
        while at < len(words):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS_AT_ONCE, "right")) - 1)
            found = _counted(words.slice(at, upto - at))
            yield from (found.slice(i, 1 << 16) for i in range(0, found.num_rows, 1 << 16))
            at = upto


def term_weights(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """term, documents, occurrences, idf of terms in min_documents documents or more, and in max_share of all at most.

    idf is ln((1 + n) / (1 + documents)) + 1. Texts are dealt into tasks by documents. Each counts the terms of its own,
    WORDS_AT_ONCE words at a time, so a term moves once for many documents. documents: doc_id (unique), text.
    """
    n = documents.count()
    words = dealt(documents.select("doc_id", "text"), n, "doc_id", most=DOCUMENTS).select(content_words(F.coalesce("text", F.lit(""))).alias("words"))
    found = words.mapInArrow(_count_terms, "term string, documents long, occurrences long").groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))
    kept = found.where((F.col("documents") >= min_documents) & (F.col("documents") <= max_share * n))
    return kept.withColumn("idf", F.log((1 + F.lit(float(n))) / (1 + F.col("documents"))) + 1)


def topics_by_terms(documents: DataFrame, topics: int = TOPICS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(topic_id, representation, count, by falling count) and (doc_id, topic_id) from k-means over weighted terms.

    documents: doc_id, text. A document without known terms is the zero vector. Cluster numbers are this engine's own.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    spark, n = documents.sparkSession, documents.count()
    # terms are counted once, which gives their order and their weights; then each text is read once more, for its vector
    known = term_weights(documents).orderBy(F.desc("occurrences"), "term").limit(VOCABULARY).select("term", "idf").collect()
    vocabulary = [r.term for r in known]
    if vocabulary:
        prepared = dealt(documents.select("doc_id", "text"), n, "doc_id", most=DOCUMENTS).select("doc_id", terms(F.coalesce("text", F.lit(""))).alias("terms"))
        counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="tf").transform(prepared)
        scaled = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in known]), inputCol="tf", outputCol="weighted").transform(counted)
        vectors = Normalizer(p=2.0, inputCol="weighted", outputCol="features").transform(scaled).select("doc_id", "features")
    else:
        raise ValueError(f"no term is in {MIN_DOCUMENTS} documents or more")
    vectors = stored(vectors, "topics-vectors")
    model = KMeans(k=max(1, min(topics, n)), seed=seed).fit(vectors)
    labelled = model.transform(vectors).select("doc_id", F.col("prediction").alias("topic_id"))
    strongest = [(i, [vocabulary[j] for j in c.argsort()[::-1][:TERMS]]) for i, c in enumerate(model.clusterCenters())]
    names = spark.createDataFrame(strongest, "topic_id int, representation array<string>")
    sizes = labelled.groupBy("topic_id").agg(F.count("*").alias("count"))
    return names.join(sizes, "topic_id").orderBy(F.desc("count"), "topic_id"), labelled


def topics_by_vectors(documents: DataFrame, topics: int = TOPICS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The same from the documents' vectors (doc_id, text, vector): clusters by k-means, named by their own terms.

    A term's weight in a cluster is its count there times ln(1 + mean cluster size / its count in all). This stands in
    for density clustering over a learned projection, which it does not reproduce.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = documents.where("vector is not null").select("doc_id", "text", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=topics, seed=seed).fit(points.select("features"))
    placed = model.transform(points).select("doc_id", "text", F.col("prediction").alias("topic_id"))  # a text takes its topic along
    labelled = stored(placed.select("doc_id", "topic_id"), "topics-labelled")
    # read by three plans below, none of which goes back to the texts
    counted = stored(placed.select("topic_id", F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("topic_id", "term").agg(F.count("*").alias("n")), "topics-counted")
    everywhere = counted.groupBy("term").agg(F.sum("n").alias("all"))
    mean = counted.groupBy().agg((F.sum("n") / F.count_distinct("topic_id")).alias("mean")).first()["mean"] or 0.0
    weighed = counted.join(everywhere, "term").withColumn("w", F.col("n") * F.log(1 + F.lit(float(mean)) / F.col("all")))
    top = weighed.withColumn("r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("w"), "term"))).where(F.col("r") <= TERMS)
    names = top.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("representation"))
    sizes = labelled.groupBy("topic_id").agg(F.count("*").alias("count"))
    return sizes.join(names, "topic_id", "left").select("topic_id", "representation", "count").orderBy(F.desc("count"), "topic_id"), labelled


def topic_query(representation: Column, separator: str = ", ") -> Column:
    return F.array_join(representation, separator)

