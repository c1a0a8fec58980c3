"""Papers, catalog tables and incremental runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import papers
from gleaner.queries import _fixtures as fx
from gleaner.sources import catalog
from gleaner.storage import fresh_folder
from gleaner.streaming import incremental


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.derived(spark, sf_dir, fx.DOIS)
    again = pages.where("page_id % 4 = 0").withColumn("page_id", F.col("page_id") + 1_000_000)
    return pages.unionByName(again)


def paper_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.deduplicated(papers.identified(_rows(spark, sf_dir)).where("pid is not null"), ["page_id"]).select("pid", "page_id", "url")


def paper_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.rejected(_rows(spark, sf_dir)).select("page_id", "error")


def paper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.to_json(F.struct(F.col("url").alias("title"), F.struct(F.concat(F.lit("10.1/"), "page_id").alias("doi")).alias("ids"), F.array(F.lit("A"), F.lit("B")).alias("authors"), F.lit("x").alias("unknown")))
    read = pages.select("page_id", papers.parsed(text).alias("p"))
    back = papers.as_json(F.col("p"))
    return read.select("page_id", "p.title", "p.ids.doi", F.array_join("p.authors", ",").alias("authors"), F.get_json_object(back, "$.keywords").alias("keywords"))


def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    refs = part.select(F.col("p_partkey").alias("ref_id"), F.upper("p_name").alias("title"))
    candidates = part.select(F.explode(F.sequence(F.col("p_partkey") - 2, F.col("p_partkey") + 2)).alias("ref_id"), F.col("p_partkey").alias("cand_pos"), F.concat("p_name", F.lit(" "), "p_brand").alias("cand_title"))
    return papers.best_titles(refs, candidates)


def warehouse_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return catalog.fitted(customer, ["c_name", "absent", "c_custkey", "inserted_at"], F.lit("2024-01-01")).where(catalog.equals_all({"c_custkey": None}))


def param_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return catalog.query(spark, "SELECT c_mktsegment, count(*) AS n FROM {customer} WHERE c_acctbal > :least AND c_mktsegment <> :segment GROUP BY c_mktsegment", {"least": 1000.0, "segment": "O'Brien"}, customer=customer)


def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("pid"), F.when(F.length("text") > 200, F.col("text")).alias("abstract"), F.col("lang").alias("request_id"))
    return catalog.abstracts(docs, {"request_id": "en", "pid": None})


@dataclass
class _Author:
    name: str
    rank: int | None = None


@dataclass
class _Record:
    title: str
    links: dict[str, str]
    authors: list[_Author]
    tags: list[str] | None = None
    score: float | None = None
    hidden: bool = False


def dataclass_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = catalog.table_schema(_Record, exclude=["hidden"])
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "name string, type string")


def incremental_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each kind of event and user, by a stream that ends with what is there."""
    source, schema = f"{sf_dir}/events.parque[t]", spark.read.parquet(f"{sf_dir}/events.parquet").schema
    output = fresh_folder(spark, "incremental-out")
    kept = lambda rows: rows.select("event_type", "user_id")
    state = fresh_folder(spark, "incremental-state")
    for _ in range(2):  # the second run finds nothing new
        incremental.run_new(incremental.new_rows(spark, source, schema), kept, output, state, ["event_type", "user_id"])
    return spark.read.parquet(output)


_DOI = "lower(trim(coalesce(nullif(doi, ''), 'NULL_DOI_' || semantic_scholar)))"
_PID = f"sha256(trim(regexp_replace({_DOI}, '^(https://doi\\.org/|doi:)', '')))"
_ALL = {"p": fx.duck(fx.DOIS), "rows": "SELECT * FROM p UNION ALL SELECT * REPLACE (page_id + 1000000 AS page_id) FROM p WHERE page_id % 4 = 0"}

QUERIES = {
    "paper_dedup": (paper_dedup, fx.with_ctes(_ALL, f"SELECT {_PID} AS pid, page_id, url FROM rows WHERE {_PID} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_PID} ORDER BY page_id) = 1")),
    "paper_rejects": (paper_rejects, fx.with_ctes(_ALL, f"SELECT page_id, 'neither a DOI nor another identifier' AS error FROM rows WHERE {_PID} IS NULL")),
    "paper_records": (paper_records, "SELECT page_id, url AS title, '10.1/' || page_id AS doi, 'A,B' AS authors, '[]' AS keywords FROM pages"),
    "title_match": (title_match, None),
    "warehouse_projection": (warehouse_projection, "SELECT c_name, c_custkey, '2024-01-01' AS inserted_at FROM customer"),
    "param_query": (param_query, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 AND c_mktsegment <> 'O''Brien' GROUP BY c_mktsegment"),
    "abstracts": (abstracts, "SELECT DISTINCT source AS pid, text AS abstract, lang AS request_id FROM documents WHERE length(text) > 200 AND lang = 'en'"),
    "dataclass_schema": (dataclass_schema, "SELECT * FROM (VALUES ('title', 'string'), ('links', 'struct<url:string,status:string>'), ('authors', 'array<struct<name:string,rank:bigint>>'), ('tags', 'array<string>'), ('score', 'double')) AS t(name, type)"),
    "incremental_distinct": (incremental_distinct, "SELECT DISTINCT event_type, user_id FROM events"),
}
