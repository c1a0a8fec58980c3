"""Ranking, similarity and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.values import equality_ratio
from gleaner.functions.vectors import stop_words, text_similarity
from gleaner.operators import metrics, ranking, topics
from gleaner.plans import topic_ranking
from gleaner.queries import _fixtures as fx

#: Pairs of neighbouring names, and vectors of whole names and of their words.
_PAIRS = """SELECT n AS a, lead(n) OVER (ORDER BY n) AS b FROM (SELECT DISTINCT p_name AS n FROM {part} UNION SELECT DISTINCT p_type FROM {part} UNION SELECT DISTINCT p_type || ' and ' || p_name FROM {part}) AS s"""


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = ranking.nearest_by_vector(asked, vectors.select(F.col("vec_id").alias("doc_pos"), F.col("embedding").alias("vector")), most=10)
    return found.select("query_id", "doc_pos", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _of_remainder(vectors: DataFrame, by: int = 500) -> DataFrame:
    """The vectors that a remainder can name, which are few whatever the table holds, to be broadcast."""
    return F.broadcast(vectors.where(F.abs("vec_id") < by))


def two_stage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("query_vector"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(_of_remainder(vectors), F.col("doc_id") % 500 == F.col("vec_id")).select(F.col("doc_id").alias("doc_pos"), "text", F.col("embedding").alias("vector"))
    found = ranking.two_stage(asked, docs)
    return found.select("query_id", "doc_pos", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = fx.derived(spark, sf_dir, _PAIRS).where("b is not null")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    values = pairs.select(F.explode(F.array("a", "b")).alias("value")).select(F.explode(F.concat(F.array("value"), F.split("value", " "))).alias("value")).distinct()
    return pairs, values.join(vectors, (F.ascii("value") * 7 + F.length("value") * 3) % 499 == F.col("vec_id")).select("value", F.col("embedding").alias("v"))


def fuzzy_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fuzzy_by_lookup(*_names(spark, sf_dir)).select("a", "b", F.round("fuzzy", 6).alias("fuzzy"))


def similarity_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of cells whose texts are compared by letters, plainly and fuzzily."""
    rows = fx.derived(spark, sf_dir, fx.MEASURES).select("id", F.coalesce("v", F.lit("")).alias("a"), F.concat(F.lit("about "), F.coalesce("v", F.lit("none"))).alias("b"))
    ratio = lambda fuzzy: F.round(equality_ratio("a", "b", text_similarity(F.col("a"), F.col("b"), fx.letters, fuzzy)), 6)
    both = lambda a, b: F.struct(ratio(False).alias("plain"), ratio(True).alias("fuzzy")).alias("m")  # noqa: E731, of columns a and b
    return fx.by_pairs(rows, both).select("id", "m.*")


def topic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a topic asks for, from its words."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.slice(topics.content_words(F.col("text")), 1, topics.TERMS).alias("w"))
    return words.select("doc_id", topics.topic_query(F.col("w")).alias("query"))


def stop_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["while", "&", "don't", "needn", "zebra", "Not", "y"]
    return spark.createDataFrame([(w, w in stop_words()) for w in asked] + [("count", len(set(stop_words())) == len(stop_words()) == 180)], "word string, listed boolean")


def topic_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topics.term_weights(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("term", "documents", "occurrences", F.round("idf", 6).alias("idf"))


def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topics_by_terms(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


def topic_clusters_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(_of_remainder(vectors), F.col("doc_id") % 500 == F.col("vec_id")).select("doc_id", "text", F.col("embedding").alias("vector"))
    return topics.topics_by_vectors(docs)[0]


def topic_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of all documents and the sentences that rank first for each."""
    return topic_ranking.ranked_topics(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words()) + "]"
_WORDS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda w: NOT list_contains(" + _STOP + ", w))"
_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_SET = "list_distinct(list_filter(string_split_regex(lower({c}), '[\\s\\x0b]+'), lambda w: w <> ''))"

QUERIES = {
    "cosine_topk": (cosine_topk, """SELECT query_id, doc_pos, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_pos) AS rank FROM (
        SELECT q.vec_id AS query_id, d.vec_id AS doc_pos, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"""),
    "two_stage_rank": (two_stage_rank, f"""WITH q AS (SELECT item_id AS query_id, text AS query, embedding AS qv FROM benchmark JOIN embeddings ON item_id = vec_id QUALIFY row_number() OVER (PARTITION BY text ORDER BY item_id) = 1),
        near AS (SELECT query_id, query, doc_id AS doc_pos, text, list_inner_product(CAST(qv AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM q, documents d JOIN embeddings e ON d.doc_id % 500 = e.vec_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_pos) <= 200),
        scored AS (SELECT query_id, doc_pos, coalesce(len(list_intersect({_SET.format(c='query')}, {_SET.format(c='text')})) / nullif(len(list_distinct(list_concat({_SET.format(c='query')}, {_SET.format(c='text')}))), 0), 0e0) AS score FROM near)
        SELECT query_id, doc_pos, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_pos) AS rank FROM scored QUALIFY rank <= 10"""),
    "fuzzy_similarity": (fuzzy_similarity, fx.with_ctes({"pairs": f"SELECT * FROM ({fx.duck(_PAIRS)}) WHERE b IS NOT NULL", "vals": "SELECT DISTINCT unnest(list_prepend(value, string_split(value, ' '))) AS value FROM (SELECT a AS value FROM pairs UNION ALL SELECT b FROM pairs)",
        "vecs": "SELECT value, embedding AS v FROM vals JOIN embeddings ON (ascii(value) * 7 + length(value) * 3) % 499 = vec_id",
        "va": f"SELECT a, unnest(list_prepend(a, list_distinct(list_filter(string_split(a, ' '), lambda w: NOT list_contains({_STOP}, w))))) AS x FROM pairs", "vb": f"SELECT b, unnest(list_prepend(b, list_distinct(list_filter(string_split(b, ' '), lambda w: NOT list_contains({_STOP}, w))))) AS y FROM pairs",
        "best": f"SELECT p.a, p.b, max({_COS.format(a='i.v', b='j.v')}) AS best FROM pairs p JOIN va ON va.a = p.a JOIN vb ON vb.b = p.b JOIN vecs i ON i.value = x JOIN vecs j ON j.value = y GROUP BY p.a, p.b"},
        f"SELECT p.a, p.b, CASE WHEN NOT (contains(p.a, ' ') OR contains(p.b, ' ')) THEN NULL ELSE round((best + {_COS.format(a='i.v', b='j.v')}) / 2, 6) END AS fuzzy FROM pairs p JOIN best ON best.a = p.a AND best.b = p.b JOIN vecs i ON i.value = p.a JOIN vecs j ON j.value = p.b")),
    "topic_tfidf": (topic_tfidf, f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), t AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
        c AS (SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM t GROUP BY term), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)
        SELECT term, documents, occurrences, round(ln((1 + n) / (1 + documents)) + 1, 6) AS idf FROM c, n WHERE documents >= 5 AND documents <= 0.8 * n"""),
    "similarity_dispatch": (similarity_dispatch, fx.with_ctes({"m": fx.duck(fx.MEASURES), "cells": "SELECT id, coalesce(v, '') AS a, 'about ' || coalesce(v, 'none') AS b FROM m", **fx.duck_fuzzy("cells")},
        "SELECT id, round(coalesce(plain, 0), 6) AS plain, round(coalesce(fuzzy, plain, 0), 6) AS fuzzy FROM cells JOIN fuzzy USING (a, b)")),
    "topic_queries": (topic_queries, f"SELECT doc_id, array_to_string({_WORDS}[1:10], ', ') AS query FROM documents"),
    "stop_word_list": (stop_word_list, """SELECT * FROM (VALUES ('while', true), ('&', true), ('don''t', true), ('needn', true), ('zebra', false), ('Not', false), ('y', true), ('count', true)) AS t(word, listed)"""),
    "topic_clusters": (topic_clusters, None),
    "topic_clusters_by_vector": (topic_clusters_by_vector, None),
    "topic_ranks": (topic_ranks, None),
}
